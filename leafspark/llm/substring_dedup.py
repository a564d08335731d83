"""Substring dedup on sliding sentence spans.

A text is cut into sentences: after a word that ends in a sentence mark (of several scripts) or a closing quote or bracket
behind one, before a word that starts a new line, and into clauses by winnowing: in every run of ``GAP`` words a cut comes
after those with the least hash, so no clause is longer and passages without punctuation, or pasted into the middle of a
sentence, align too. All three depend on words near the cut only, so a passage is cut alike wherever it stands, but for
its first and last few words. Scripts without spaces count each character as half a word.

From each sentence a span runs over several consecutive sentences: two at least, and on to ``min_words`` words; and one runs
back from each sentence's end in the same way. Every span is hashed over its words (case kept, whitespace not). The least
document of each hash is found over the whole corpus, by doc_id; a span is a repeat if a lesser document holds it or it
stood earlier in its own text. A repeated span at an end of such a run grows outwards word by word, up
to ``GROWTH`` words, as long as the words are those around the span's first occurrence: so a passage goes to its ends and not only to
the cuts nearest to them. Sentences and words that repeats cover are removed; the first occurrence stays.

A document sends each hash once, minima are taken before the shuffle, and only hashes of several documents are joined
back, one row each, so a passage that a third of all documents share can be split over tasks. The words around a span are
sent by its first holder only, and for spans that others hold.

Defined results: a document is a doc_id and a text; rows equal in both are one document and share their result; texts
that have no id, or share one, are documents of their own and come last, in order of a hash; a null text stays null; a text that is all repeats
becomes empty; other text is returned as it was, whitespace included; an empty table gives no rows; other columns are
ignored. A text is held whole, with some 40 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .npbytes import _BYTES, _STEPS, U64, WHITESPACE, mix, segment_hashes, text_slices
from .store import materialize, release

MIN_WORDS = 20
MIN_SENTENCES = 2
#: Words of which one ends a clause, and words by which a repeat may grow to a side.
GAP, GROWTH = 16, 8
_LAST = 2**63 - 1

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[[ord(c) for c in "\"')]}"]] = True
#: Sentence marks of other scripts, by their last bytes.
_MARKS = [c.encode() for c in "。！？｡।؟۔"]


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Whether a character begins here that is written without spaces: Thai, Lao, Kana, Han and full-width forms."""
    next_ = np.append(data[1:], np.uint8(0))
    return ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (next_ >= 0xB8) & (next_ <= 0xBB)) | ((data == 0xEF) & (next_ >= 0xBC) & (next_ <= 0xBE)) | ((data == 0xF0) & (next_ >= 0xA0))


def words(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The words of all texts of a slice, unspaced characters as words of their own: first byte, byte after the last, text,
    half words before (one more than words), hash, and the words before each text (one more than texts)."""
    space = WHITESPACE[data]
    alone = _unspaced(data)
    first = np.empty(len(data), bool)
    first[:1] = True
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first |= alone
    at = np.flatnonzero(alone)
    behind = at + np.where(data[at] >= 0xF0, 4, 3)
    first[behind[behind < len(data)]] = True
    first &= ~space
    start = np.flatnonzero(first)
    values = _BYTES[data]
    values[space] = 0
    before = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    gap = np.flatnonzero(space)
    end = np.append(gap, len(data))[np.searchsorted(gap, start)]
    end = np.minimum(np.minimum(end, np.append(start[1:], len(data))), offsets[owner + 1])
    halves = np.concatenate([[0], np.cumsum(2 - alone[start])])
    return {"start": start, "end": end, "owner": owner, "halves": halves, "hash": segment_hashes(values, start, len(data)), "before": before}


def _over_runs(values: np.ndarray, gap: int, of: np.ufunc) -> np.ndarray:
    """``of`` (a minimum or maximum) over each run of ``gap`` values, by doubling."""
    size = 1
    while size < gap:
        step = min(size, gap - size)
        values = of(values[: len(values) - step], values[step:])
        size += step
    return values


def _ends_clause(hashes: np.ndarray, owner: np.ndarray, gap: int) -> np.ndarray:
    """Whether a word has the least hash of some run of ``gap`` words of its text."""
    if len(hashes) < gap:
        return np.zeros(len(hashes), bool)
    least = _over_runs(hashes, gap, np.minimum)
    least[owner[: len(least)] != owner[gap - 1 :]] = 0  # runs over a text's end don't count
    around = np.zeros(gap - 1, U64)
    return _over_runs(np.concatenate([around, least, around]), gap, np.maximum) == hashes


def sentence_starts(data: np.ndarray, w: dict[str, np.ndarray], gap: int = GAP) -> np.ndarray:
    """The first word of each sentence or clause."""
    start, end, owner, n = w["start"], w["end"], w["owner"], len(w["start"])
    last = end - 1
    stop = _STOP[data[last]] | (_CLOSER[data[last]] & (last > start) & _STOP[data[np.maximum(last - 1, 0)]])
    other = np.flatnonzero(data[last] >= 0x80)
    for mark in _MARKS:
        tail = last[other]
        same = tail - start[other] >= len(mark) - 1
        for k, byte in enumerate(reversed(mark)):
            same &= data[np.maximum(tail - k, 0)] == byte
        stop[other] |= same
    stop |= _ends_clause(w["hash"], owner, gap)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = stop[:-1] | (newlines[start[1:]] > newlines[last[:-1]]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(first)


def _spans(data: np.ndarray, offsets: np.ndarray, min_words: int) -> dict:
    """Words and sentences of all texts of a slice, and the spans in order of text and place: text, first word, the word after the
    last, and hash."""
    w = words(data, offsets)
    n = len(w["start"])
    if not n:
        none = np.zeros(0, np.int64)
        return w | {"sentence": none, "of": none, "a": none, "b": none, "span": np.zeros(0, U64)}
    sentence = sentence_starts(data, w)
    of = w["owner"][sentence]
    bounds = np.searchsorted(sentence, w["before"])
    edge = np.append(sentence, n)  # the first word of each sentence, and the end
    halves = w["halves"][edge]
    here = np.arange(len(sentence))
    # Forward, a span ends before the first sentence, two on at least, that starts min_words words later; backward, it
    # starts at the last sentence, two back at least, from which there are min_words words.
    after = np.maximum(np.searchsorted(halves, halves[:-1] + 2 * min_words), here + MIN_SENTENCES)
    fits = (after < len(edge)) & (after <= bounds[of + 1])
    first_back = np.minimum(np.searchsorted(halves[:-1], halves[1:] - 2 * min_words, "right") - 1, here + 1 - MIN_SENTENCES)
    fits_back = first_back >= bounds[of]
    a = edge[np.concatenate([here[fits], first_back[fits_back]])]
    b = edge[np.concatenate([after[fits], here[fits_back] + 1])]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    # A span's hash is a polynomial's difference of running sums, scaled to start at one power.
    base = U64(0xC2B2AE3D27D4EB4F)
    inverse = U64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
    power = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n - 1, base)]))
    back = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n - 1, inverse)]))
    run = np.concatenate([[U64(0)], np.cumsum(w["hash"] * power, dtype=U64)])
    span = mix((run[b] - run[a]) * back[a] + (b - a).astype(U64) * _STEPS[0])
    return w | {"sentence": sentence, "of": w["owner"][a], "a": a, "b": b, "span": span}


def _send_spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for row, _, data, offsets in text_slices(batch.column("text")):
                s = _spans(data, offsets, min_words)
                owner, span = s["of"] + row, s["span"]
                order = np.lexsort((span, owner))
                owner, span = owner[order], span[order]
                new = np.ones(len(order), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (span[1:] != span[:-1])
                yield pa.RecordBatch.from_pydict({"span": pa.array(span[new].view(np.int64)), "key": pa.array(keys[owner[new]])})

    return run


def _around(s: dict, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each of the words before and after a run of words, outwards, within its text."""
    text = s["owner"][a]
    low, high = s["before"][text], s["before"][text + 1]
    front = s["hash"][max(low, a - GROWTH) : a][::-1]
    return front.astype(np.uint16), s["hash"][b : min(high, b + GROWTH)].astype(np.uint16)


def _send_contexts(min_words: int):
    """(span, first, before, after): the words around the first occurrence of each of a document's spans that are asked for,
    and the document's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, keys = batch.column("spans"), batch.column("holder").to_pylist()
            for row, end, data, offsets in text_slices(batch.column("text")):
                s = _spans(data, offsets, min_words)
                parts = np.searchsorted(s["of"], np.arange(end - row + 1))
                span, key, before, after = [], [], [], []
                for i in range(end - row):
                    wanted = asked[row + i].values.to_numpy().view(U64)
                    seen, first = np.unique(s["span"][parts[i] : parts[i + 1]], return_index=True)
                    for k in np.flatnonzero(np.isin(seen, wanted)).tolist():
                        at = parts[i] + first[k]
                        front, back = _around(s, s["a"][at], s["b"][at])
                        span.append(int(seen[k].view(np.int64)))
                        key.append(keys[row + i])
                        before.append(front.tobytes())
                        after.append(back.tobytes())
                yield pa.RecordBatch.from_pydict({"span": pa.array(span, pa.int64()), "first": pa.array(key, pa.int64()), "before": pa.array(before, pa.binary()), "after": pa.array(after, pa.binary())})

    return run


def _alike(own: np.ndarray, other: np.ndarray) -> int:
    """How many words two runs of words share at their beginnings."""
    n = min(len(own), len(other))
    differ = np.flatnonzero(own[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


def _covered(s: dict, i: int, parts: np.ndarray, lists: pa.Scalar | None) -> np.ndarray:
    """Whether each word of a text is in a repeat. Spans at the ends of a run of repeats grow outwards."""
    low, high = int(s["before"][i]), int(s["before"][i + 1])
    at = slice(parts[i], parts[i + 1])
    spans, starts, ends = s["span"][at], s["a"][at], s["b"][at]
    seen, earliest, which = np.unique(spans, return_index=True, return_inverse=True)
    known = {}
    if lists is not None:
        known = {x["span"] & (2**64 - 1): (x["before"], x["after"]) for x in lists.as_py()}
    elsewhere = np.isin(spans, np.fromiter(known, U64, len(known)))
    repeat = elsewhere | (starts > starts[earliest][which])
    if not repeat.any():
        return np.zeros(high - low, bool)

    def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cover = np.zeros(high - low + 1, np.int64)
        np.add.at(cover, a - low, 1)
        np.add.at(cover, b - low, -1)
        return np.cumsum(cover[:-1]) > 0

    covered = spread(starts[repeat], ends[repeat])
    edged = np.concatenate([[False], covered, [False]])
    outer = np.flatnonzero(repeat & (~edged[starts - low] | ~edged[ends - low + 1]))
    new_starts, new_ends = starts[outer].copy(), ends[outer].copy()
    for k, j in enumerate(outer.tolist()):
        a, b, first = int(starts[j]), int(ends[j]), int(earliest[which[j]])
        if elsewhere[j]:
            front, back = (np.frombuffer(x, np.uint16) for x in known[int(spans[j])])
        else:
            front, back = _around(s, int(starts[first]), int(ends[first]))
            back = back[: max(0, a - int(ends[first]))]  # not into itself
        own_front, own_back = _around(s, a, b)
        if not edged[a - low]:
            new_starts[k] -= _alike(own_front, front)
        if not edged[b - low + 1]:
            new_ends[k] += _alike(own_back, back)
    return covered | spread(new_starts, new_ends)


def _clean(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            taken = batch.column("spans")
            for row, end, data, offsets in text_slices(texts):
                s = _spans(data, offsets, min_words)
                parts = np.searchsorted(s["of"], np.arange(end - row + 1))
                sentences = np.searchsorted(s["sentence"], s["before"])
                raw = data.tobytes()
                sizes, removed, out = [], [], []
                for i in range(end - row):
                    covered = _covered(s, i, parts, taken[row + i] if taken[row + i].is_valid else None)
                    low, hi = int(s["before"][i]), int(offsets[i + 1])
                    own = s["sentence"][sentences[i] : sentences[i + 1]] - low
                    gone = int(np.logical_or.reduceat(covered, own).sum()) if len(own) else 0
                    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    edges = np.append(s["start"][low : low + len(covered)], hi)
                    at, kept, cuts, chars = int(offsets[i]), [], [], 0
                    for x, y in zip(change[::2], change[1::2], strict=True):
                        kept.append(raw[at : edges[x]])
                        a = chars + len(kept[-1].decode())
                        chars = a + len(raw[edges[x] : edges[y]].decode())
                        cuts.append((a, chars))
                        at = int(edges[y])
                    kept.append(raw[at:hi])
                    sizes.append((len(own), gone, int(covered.sum())))
                    removed.append(cuts)
                    out.append(b"".join(kept).decode() if known[row + i] else None)
                flat = [x for cuts in removed for x in cuts]
                items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)], ["start", "end"])
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in removed])]), pa.int32())
                counts = {name: pa.array([x[k] for x in sizes], pa.int64()) for k, name in enumerate(("n_sentences", "n_removed", "n_words_removed"))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[row:end]} | counts | {"removed": pa.ListArray.from_arrays(ends, items), "text": pa.array(out, pa.string())})

    return run


def _keyed(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) and the number by which documents are ordered: an id that stands for one text only is its own;
    texts without an id, or that share one, have a hash of both from 2**62 on."""
    mark = F.xxhash64("doc_id", "text")
    apart = F.shiftrightunsigned(mark, 2).bitwiseOR(F.lit(1 << 62))
    shared = texts.where("doc_id is not null").groupBy(F.col("doc_id").alias("several")).agg(F.min(mark).alias("a"), F.max(mark).alias("b"))
    shared = materialize(shared.where("a < b").select("several"))
    if shared.isEmpty():
        return texts.withColumn("key", F.when(F.col("doc_id").isNull(), apart).otherwise(F.col("doc_id")))
    both = texts.join(shared, F.col("doc_id") == F.col("several"), "left")
    return both.withColumn("key", F.when(F.col("doc_id").isNull() | F.col("several").isNotNull(), apart).otherwise(F.col("doc_id"))).drop("several")


def drop_repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_words_removed, removed, text) for each row: ``n_removed`` sentences are touched by
    repeats, ``removed`` lists the code points taken out (start, end of the old text) and ``text`` is what stays."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = _keyed(texts)
    spans = texts.select("key", "text").mapInArrow(_send_spans(min_words), "span long, key long")
    # Most spans occur in one document; what goes on is what several documents hold.
    first = spans.groupBy("span").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    first = materialize(first.select("span", "first"))
    asked = materialize(first.groupBy(F.col("first").alias("holder")).agg(F.collect_list("span").alias("spans")))
    release(spark, first)
    holders = texts.join(asked, F.col("key") == F.col("holder")).select("holder", "text", "spans")
    contexts = holders.mapInArrow(_send_contexts(min_words), "span long, first long, before binary, after binary")
    contexts = materialize(contexts.dropDuplicates(["span"]))  # equal rows send the same
    release(spark, asked)
    later = spans.join(contexts, "span").where("key <> first").groupBy(F.col("key").alias("holder"))
    later = materialize(later.agg(F.collect_list(F.struct("span", "before", "after")).alias("spans")))
    release(spark, contexts)
    both = texts.join(later, F.col("key") == F.col("holder"), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_clean(min_words), "doc_id long, n_sentences long, n_removed long, n_words_removed long, removed array<struct<start int, end int>>, text string")
