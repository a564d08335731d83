import zlib
from collections import defaultdict

import numpy as np

from leafspark.llm import packing as P
from leafspark.llm.queries import tokenizer_path

ODD = ["it's 'tis  we've\n\n  foo'll''s 'S don't!'s \t x", "  ", "", "\n", " a", "a ", "'re 'rex 'v", "x y   z", "日本 語 abc<|endoftext|>d", "1's2 ½ ²x a'", "'", "a 's b", "\n's", "  's", "ét‍　 \x1c a", "\x85 q", "..'s 'll", "''s", "5'6\"", "emoji 😀 ok", "nul\x00 byte"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_ids_are_the_librarys(docs):
    texts = ODD + [r.text for r in docs.collect()]
    want = [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]
    got = P.Tokens(tokenizer_path()).encode(texts)
    assert [list(map(int, x)) for x in got] == want
    small = P.Tokens(tokenizer_path(), keep=10)
    assert [list(map(int, small.encode([t])[0])) for t in texts[:40]] == want[:40]


def test_pieces_and_places(spark, odd, docs):
    frame = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = frame.collect()
    out = P.pack_documents(frame, tokenizer_path(), with_ids=True).collect()
    t = tokenizer()
    want = defaultdict(int)
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in out) // 1024)
    assert len(bins) <= least * 1.03 + 4 * frame.rdd.getNumPartitions()
    whole = P.sequences(spark.createDataFrame(out)).collect()
    assert sum(len(r.input_ids) for r in whole) == sum(r.length for r in out)


def test_local_search_raises_squared_fill_and_empties_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(100, 700, 600)
    start = [[i] for i in range(600)]
    better = P.local_search([list(b) for b in start], lengths, 1024, passes=6)
    fill = [int(lengths[b].sum()) for b in better]
    assert sorted(i for b in better for i in b) == list(range(600)) and max(fill) <= 1024
    assert len(better) < 600 and sum(f * f for f in fill) > int((lengths**2).sum())


def test_lengths_that_are_stored_apart_are_packed_together(spark, monkeypatch):
    """600 tokens a document in some partitions and 400 in others: as many sequences as documents of one kind."""
    monkeypatch.setattr(P, "POOL", 128)
    t = tokenizer()
    word = next(w for w in (" the", " a", " of") if len(t.encode(w * 50, add_special_tokens=False).ids) == 50)
    rows = [(i, word * (599 if i < 400 else 399)) for i in range(800)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    out = P.pack_documents(docs, tokenizer_path()).collect()
    assert len(out) == 800 and {r.length for r in out} == {600, 400}
    assert len({r.sequence_id for r in out}) <= 400 + 7


def test_nothing_and_empty(spark, empty):
    assert P.pack_documents(empty, tokenizer_path()).count() == 0
    assert P.pack(np.array([1024, 1024, 1])) == [[0], [1], [2]]


def test_every_character_is_classed_as_the_library_does():
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} {chr(c)}'s" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    want = [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]
    got = P.Tokens(tokenizer_path()).encode(texts)
    assert [t for t, a, b in zip(texts, got, want) if a.tolist() != b] == []
