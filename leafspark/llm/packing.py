"""Best-fit packing of token sequences, improved by a swap-based local search.

A document is its tokens and an end token. One longer than ``width`` is cut into pieces of ``width`` tokens, of which
the first may be shorter. Pieces of full width are sequences by themselves. The others are pooled, packed by best fit
in order of falling length, and then exchanged between underfull sequences: a piece moves, or is swapped for a smaller
one, or any two of a sequence are swapped for one, whenever that raises the sum of squared fills. As fuller sequences get fuller the
emptiest run out of pieces, and sequences that have none left vanish.

Pieces are written once with a key each. Those below full width are counted by length, ordered by length over the
whole table and dealt out in turn, so that each pool of about ``POOL`` pieces has the whole table's mix of lengths, to
one piece of each length, however the input is stored. Only keys and lengths are shuffled to be packed; memory is
bounded by the pool. The places are then joined to the ids. Each pool leaves at most a few sequences short of what all
pieces together would need.

Tokens: texts are cut by the vocabulary's own pattern into pretokens with array operations, and each different
pretoken is tokenised once per task. Texts with characters above U+2FFF or unknown to this Python, or with the
vocabulary's special strings, go through the ``tokenizers`` library as they are.

Defined results: a null or empty text is the end token alone; repeated rows are pieces of their own; an empty table
gives no rows; other columns are ignored, whatever their names. A text is held whole, with some 20 bytes for each of its
characters.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .npbytes import U64, mix, segment_hashes
from .store import materialize

WIDTH = 1024
END_ID = 2
POOL = 8192
#: Characters that are tokenised at once.
_CHARS = 1 << 19
_PLAIN = 0x3000
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)


def _classes() -> np.ndarray:
    out = np.full(_PLAIN + 1, _OTHER, np.uint8)
    for cp in range(_PLAIN):
        kind = unicodedata.category(chr(cp))
        # What this Python has no character for, the tokenizer's library may: such texts are its own.
        out[cp] = _EDGE if kind == "Cn" else _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = _SPACE
    out[_PLAIN] = _EDGE
    return out


_CLASS = _classes()
_CHAR_HASH = mix(np.arange(1, _PLAIN + 2, dtype=U64))
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")


def pretoken_starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pretokens start in texts with an edge before and after each. The rules are those of the vocabulary's
    pattern: 's 't 're 've 'm 'll 'd, then runs of letters, numbers or others with one space before, then
    whitespace, of which a run leaves its last character to what follows."""
    n = len(cp)
    space = kind == _SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _EDGE, kind[:-1]
    start = (kind != before) | (kind == _EDGE)
    # A run of whitespace gives its last character away unless a text's end follows: a space is led by the next run.
    follows = np.append(kind[1:], np.uint8(_EDGE))
    last = space & (follows != _SPACE) & (follows != _EDGE)
    start[last] = True
    led = np.flatnonzero(last & (cp == 0x20)) + 1
    start[led] = False
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[quote + 2 < n]
    if len(quote):
        one, two = cp[quote + 1], cp[quote + 2]
        size = np.zeros(len(quote), np.int64)
        for a in _SHORT:
            size[one == ord(a)] = 2
        for a, b in _LONG:
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = quote[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + size
        start[end[kind[end] == _LETTER]] = True
    return np.flatnonzero(start)


def _code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _PLAIN)


class Tokens:
    """Token ids of texts, by one vocabulary file."""

    def __init__(self, path: str, keep: int = 1_200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self._merger(path)
        self.keep = keep
        self._clear()

    def _merger(self, path: str):
        """Makes the ids of many pretokens, end to end, and the number of ids of each. tiktoken's merges are used where a file of the same vocabulary lies
        beside: same ids, less time. Pretokens go through in one call, NUL between, which is a token of its own."""
        import base64
        from pathlib import Path

        def one_by_one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [np.array(x.ids, np.int32) for x in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            return one_by_one
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        core = tiktoken.Encoding(ranks.stem, pat_str=r"[^\x00]+|\x00", mergeable_ranks=table, special_tokens={})
        nul = table[b"\0"]

        def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            joined = "\0".join(texts)
            if joined.count("\0") != len(texts) - 1:
                return one_by_one(texts)
            ids = np.array(core.encode_ordinary(joined), np.int32)
            at = np.flatnonzero(ids == nul)
            return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

        return together

    def _clear(self) -> None:
        self.slots = np.zeros(1 << 16, U64)  # open addressing: a pretoken's hash, and its number beside
        self.number = np.zeros(1 << 16, np.int32)
        self.known = 0
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, or -1."""
        mask = U64(len(self.slots) - 1)
        slot = hashes & mask
        there = self.slots[slot]
        out = np.where(there == hashes, self.number[slot], np.int32(-1))
        going = np.flatnonzero((there != hashes) & (there != 0))
        slot = slot[going]
        while len(going):
            slot = (slot + U64(1)) & mask
            there = self.slots[slot]
            same = there == hashes[going]
            out[going[same]] = self.number[slot[same]]
            stay = ~same & (there != 0)
            going, slot = going[stay], slot[stay]
        return out

    def _store(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put different hashes that aren't there into the first free slots."""
        mask = U64(len(self.slots) - 1)
        slot = hashes & mask
        while len(hashes):
            free = self.slots[slot] == 0
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(hashes), bool)
            wins[first] = True
            wins &= free
            self.slots[slot[wins]], self.number[slot[wins]] = hashes[wins], numbers[wins]
            hashes, numbers, slot = hashes[~wins], numbers[~wins], (slot[~wins] + U64(1)) & mask

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        new, size = self.model(texts)
        place = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, new])
        self.place, self.size = np.concatenate([self.place, place]), np.concatenate([self.size, size])
        number = np.arange(self.known, self.known + len(texts), dtype=np.int32)
        self.known += len(texts)
        if self.known * 2 > len(self.slots):
            used = self.slots != 0
            old = self.slots[used], self.number[used]
            size = 1 << (self.known * 3).bit_length()
            self.slots, self.number = np.zeros(size, U64), np.zeros(size, np.int32)
            self._store(*old)
        self._store(hashes, number)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        batch, chars = [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._as_is(text)
                continue
            batch.append(i)
            chars += len(text)
            if chars >= _CHARS:
                self._plain(texts, batch, out)
                batch, chars = [], 0
        if batch:
            self._plain(texts, batch, out)
        return out

    def _as_is(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def _plain(self, texts: list[str], batch: list[int], out: list) -> None:
        if self.known > self.keep:
            self._clear()
        edge = chr(_PLAIN)
        joined = edge + edge.join(texts[i] for i in batch) + edge
        cp = _code_points(joined)
        kind = _CLASS[cp]
        if np.count_nonzero(kind == _EDGE) != len(batch) + 1:
            for i in batch:
                if (_CLASS[_code_points(texts[i])] == _EDGE).any():
                    out[i] = self._as_is(texts[i])
            batch = [i for i in batch if out[i] is None]
            if batch:
                self._plain(texts, batch, out)
            return
        starts = pretoken_starts(cp, kind)
        hashes = segment_hashes(_CHAR_HASH[cp], starts, len(cp))
        number = self._find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            seen, first = np.unique(hashes[new], return_index=True)
            ends = np.append(starts, len(cp))
            self._learn(seen, [joined[ends[i] : ends[i + 1]] for i in new[first]])
            number[new] = self._find(hashes[new])
        edges = np.flatnonzero(kind[starts] == _EDGE)
        place, size = self.place[number], self.size[number]
        size[edges] = 0
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(place - (ends - size), size) + np.arange(ends[-1])]
        cuts = ends[edges]
        for i, a, b in zip(batch, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = ids[a:b]


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Bins of piece numbers, by best fit in order of falling length."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    rooms: list[int] = []  # rooms that some bin has, sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            where, room = len(bins), width
            bins.append([])
        else:
            room = rooms[at]
            where = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[where].append(i)
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(where)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, width: int, passes: int | None = None) -> list[list[int]]:
    """Moves and swaps between underfull bins that raise the sum of squared fills, until none is found or, if given,
    ``passes`` passes over the emptiest bins are done; bins without pieces are dropped."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    for _ in itertools.count() if passes is None else range(passes):
        under = np.flatnonzero((fill > 0) & (fill < width))
        if len(under) < 2:
            break
        under = under[np.argsort(fill[under], kind="stable")]
        changed = False
        item = np.array([i for b in under for i in bins[b]], np.int64)
        where = np.repeat(under, [len(bins[b]) for b in under])
        size = lengths[item]
        for poor in under.tolist():
            if not 0 < fill[poor] < width:
                continue
            for a in sorted(bins[poor], key=lambda i: -lengths[i]):
                la = int(lengths[a])
                rooms = width - fill[under]
                fits = np.flatnonzero((rooms >= la) & (fill[under] > fill[poor] - la) & (fill[under] > 0) & (under != poor))
                if len(fits):  # move to the tightest that takes it
                    to = int(under[fits[np.argmin(rooms[fits])]])
                    bins[poor].remove(a)
                    bins[to].append(a)
                    where[item == a] = to
                    fill[poor] -= la
                    fill[to] += la
                    changed = True
                    continue
                # one for one: a smaller piece comes back and the other bin gets as full as can be
                gain = la - size
                ok = np.flatnonzero((gain > 0) & (gain <= width - fill[where]) & (where != poor) & (fill[where] + gain > fill[poor]))
                if len(ok):
                    k = ok[np.argmin((width - fill[where] - gain)[ok])]
                    b, to = int(item[k]), int(where[k])
                    bins[poor].remove(a)
                    bins[to].remove(b)
                    bins[poor].append(b)
                    bins[to].append(a)
                    where[item == a], where[k] = to, poor
                    fill[poor] -= int(gain[k])
                    fill[to] += int(gain[k])
                    changed = True
            pairs = {int(lengths[[a, b]].sum()): [a, b] for a, b in itertools.combinations(bins[poor], 2)}
            for total, pair in sorted(pairs.items()):  # two for one, each sum of two lengths once
                gain = total - size
                ok = np.flatnonzero((gain > 0) & (gain <= width - fill[where]) & (where != poor) & (fill[where] + gain > fill[poor]))
                if len(ok):
                    k = ok[np.argmin((width - fill[where] - gain)[ok])]
                    b, to = int(item[k]), int(where[k])
                    for a in pair:
                        bins[poor].remove(a)
                        where[item == a] = to
                    bins[to].remove(b)
                    bins[poor].append(b)
                    bins[to] += pair
                    where[k] = poor
                    fill[poor] -= int(gain[k])
                    fill[to] += int(gain[k])
                    changed = True
                    break
        if not changed:
            break
    return [b for b in bins if b]


def pack(lengths: np.ndarray, width: int = WIDTH) -> list[list[int]]:
    """Bins of the numbers of all pieces, each of ``width`` at most."""
    full = np.flatnonzero(lengths == width)
    rest = np.flatnonzero(lengths < width)
    bins = local_search(best_fit(lengths[rest], width), lengths[rest], width)
    return [[int(i)] for i in full] + [[int(rest[i]) for i in b] for b in bins]


def _pieces(path: str, width: int, end_id: int):
    """Pieces of all texts: part and nth of its length there, a key, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        key, seen = part << 40, np.zeros(width + 1, np.int64)
        names = ["key", "part", "nth", "doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row in range(0, len(doc_ids), 256):
                held: dict = {k: [] for k in names}
                texts = [t or "" for t in batch.column(1)[row : row + 256].to_pylist()]
                for doc_id, own in zip(doc_ids[row : row + 256], tokens.encode(texts), strict=True):
                    own = np.append(own, np.int32(end_id)).astype(np.int32)
                    cuts = [0, *range((len(own) - 1) % width + 1, len(own) + 1, width)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        values = [key, part, int(seen[b - a]), doc_id, piece, a, b - a, own[a:b]]
                        for k, v in zip(names, values, strict=True):
                            held[k].append(v)
                        key += 1
                        seen[b - a] += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in held.items()})

    return run


def _pack_pools(width: int):
    """Places of the pieces of pools; a pool's rows come together, sorted by pool and key. Sequences have odd numbers,
    those of full pieces even ones."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        pool = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        base = pool.column("pool")[0].as_py() << 32
        length = pool.column("length").to_numpy()
        number, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k, b in enumerate(pack(length, width)):
            number[b] = 2 * (base + k) + 1
            offset[b] = np.cumsum(length[b]) - length[b]
        return pa.RecordBatch.from_pydict({"key": pool.column("key"), "sequence_id": pa.array(number), "offset": pa.array(offset)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pools = batch.column("pool").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pools)) + 1).tolist(), len(pools)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts and parts[-1].column("pool")[0].as_py() != pools[a]:
                    yield flush(parts)
                    parts = []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield flush(parts)

    return run


def _places(pieces: DataFrame, width: int) -> DataFrame:
    """(key, sequence_id, offset) of the pieces that are shorter than ``width``."""
    short = pieces.where(F.col("length") < width).select("key", "part", "nth", "length")
    counts = materialize(short.groupBy("length", "part").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    pools = max(1, -(-total // POOL))
    # Where each length starts among all (at most ``width`` rows), and each part within its length.
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))
    lengths = lengths.select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("base"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    first = counts.withColumn("before", before).join(F.broadcast(lengths), "length").select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    dealt = short.join(first.hint("merge"), ["length", "part"]).select("key", "length", F.pmod(F.col("first") + F.col("nth"), F.lit(pools)).alias("pool"))
    dealt = dealt.repartition(pools, "pool").sortWithinPartitions("pool", "key")
    return dealt.mapInArrow(_pack_pools(width), "key long, sequence_id long, offset long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield batch.append_column("ids_crc32", pa.array(crc, pa.int64()))


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` and ids_crc32, made from its ids (little-endian, four bytes each)."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in packed.dtypes)
    return packed.mapInArrow(_digest, f"{kinds}, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids with ``with_ids``, for each piece; the
    digest is made from the packed ids. ``tokenizer`` is the path of a vocabulary file of the ``tokenizers`` library,
    the same on all machines."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "key long, part long, nth long, doc_id long, piece long, start long, length long, ids array<int>"
    pieces = materialize(texts.mapInArrow(_pieces(tokenizer, width, end_id), schema))
    of = ["doc_id", "piece", "start", "length", "ids"]
    full = pieces.where(F.col("length") == width).select(*of, (F.col("key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < width).join(_places(pieces, width).hint("merge"), "key")
    packed = digests(full.unionAll(short.select(*of, "sequence_id", "offset")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids, document_starts) from pack_documents(with_ids=True); each is of bounded width."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(pieces.alias("pieces"))
    return out.select("sequence_id", F.flatten(F.transform("pieces", lambda p: p.ids)).alias("input_ids"), F.transform("pieces", lambda p: p.offset).alias("document_starts"))
