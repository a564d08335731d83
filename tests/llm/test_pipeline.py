"""run() against a plain Python version of all five stages."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from leafspark.llm import packing, secrets_scan, weak_quality
from leafspark.llm.queries import oracle_sql, tokenizer_path
from tests.llm.test_native import WORD, brute_quality, brute_targets, plain_em, plain_posterior
from tests.llm.test_superminhash import brute

SF = "/root/testdata/sf0.001"
_documents = pq.read_table(f"{SF}/documents.parquet").to_pandas().itertuples()
_documents = list(_documents)


def rule_votes(text):
    n, chars, symbols, dup, repeat = brute_quality(text)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    per = lambda x: x / n if n else 0.0
    of = {"n_words": n, "mean_word": per(chars), "symbol_share": per(symbols), "dup_line_share": dup / len(lines) if lines else 0.0, "repeat_share": per(repeat), "distinct_share": per(len(set(words))), "bang_share": per(text.count("!")), "stop_share": per(sum(map(text.count, ".!?")))}
    votes = tuple(-1 if of[m] < low or of[m] > high else 1 if start <= of[m] <= stop else 0 for _, m, low, high, start, stop in weak_quality.RULES)
    return votes, n < 50 or 100 * repeat > 50 * n


def test_run_equals_plain_python(spark):
    docs = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    voted = [rule_votes(t) for _, t, _ in docs]
    share, bad = plain_em([v for v, _ in voted])
    docs = [d for d, (v, failed) in zip(docs, voted) if not failed and plain_posterior(share, bad, v)[0] >= 0.5]
    kept = {d for d, _, c in brute([(d, t) for d, t, _ in docs], 5, 80) if d == c}
    docs = [d for d in docs if d[0] in kept]

    owners = defaultdict(set)
    for _, t, s in docs:
        for c in secrets_scan.candidates(t):
            owners[c[5]].add(s)
    redacted = []
    for d, t, s in docs:
        live = sorted((c[3], c[4]) for c in secrets_scan.candidates(t) if c[6] and len(owners[c[5]]) < secrets_scan.EXAMPLE_OWNERS)
        at, out = 0, ""
        for a, b in live:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        redacted.append((d, out + t[at:], s))

    sizes = defaultdict(int)
    for _, t, s in redacted:
        sizes[s] += len(WORD.findall(t))
    target = brute_targets(sizes)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t, s in redacted:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"0:{d}:{hashlib.md5(t.encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) / 2**52
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for _ in range(math.floor(rate) + (draw < rate - math.floor(rate))):
            want.update((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


NAMES = ["size", "row", "live", "key", "component", "kept", "votes", "copies", "target", "__row", "nth", "words", "__id"]
SECRET = "Zk39fQpL2vXw81Tb"


def long_odd_rows():
    """Texts that pass the quality rules, under null, shared and repeated ids, exact and near copies, secrets, and odd ones."""
    clean = [r.text for r in _documents if r.text and 80 < len(r.text.split()) < 200 and brute_quality(r.text)[2] == 0 and brute_quality(r.text)[4] == 0][:9]
    near = clean[1].rsplit(" ", 1)[0] + " indeed."
    texts = [(None, clean[0], "a"), (1, clean[1], "a"), (2, near, "b"), (2, clean[2], "b"), (2, clean[2], "b"), (3, clean[3] + f' password = "{SECRET}" end', None), (3, clean[4], "a"), (None, clean[5], None), (None, clean[5], None), (None, clean[6], "c"), (4, None, "a"), (5, "", "a"), (6, " \n ", None), (7, "word " * 30_000, "a"), (8, (" ".join(clean[7:9]) + "\n") * 1, "\U0001f600")]
    return [(d, t, "en", s, None if d == 3 else len(t or ""), *NAMES) for d, t, s in texts], clean, near


def test_odd_rows_reach_every_stage(spark, odd, empty):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows, clean, near = long_odd_rows()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(n).alias(n) for n in NAMES))
    docs = docs.where(~F.col("text").isin(clean)).withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(spark.createDataFrame(rows, schema))
    columns, of = docs.columns, lambda d: Counter((r.doc_id, r.text) for r in d.collect() if (r.doc_id or 0) < 10_000)
    found = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and all(tuple(r[5:]) == tuple(NAMES) for r in docs.collect())
        found.append(of(docs))
    passed, different, without, mixed = found
    want = Counter((d, t) for d, t, *_ in rows if t and 80 < len(t.split()) < 1000)
    assert passed == want
    gone = Counter({(2, near): 1, (2, clean[2]): 1, (None, clean[5]): 1})
    assert different == want - gone
    assert without == Counter({(d, t.replace(SECRET, "[SECRET]")): n for (d, t), n in different.items()})
    assert mixed and set(mixed) <= set(without)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()
    for frame in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        assert frame.count() == 0


def test_the_packed_corpus_comes_from_the_result_alone(spark, odd):
    docs = odd.drop("size", "row").where("doc_id <> 6")
    out = corpus_pipeline.STAGES[-1][1](spark, docs.union(docs), SF)
    rows = out.collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    whole = packing.sequences(out.sparkSession.createDataFrame(rows, out.schema)).collect()
    assert Counter(x for s in whole for x in s.input_ids) == Counter(x for r in rows for x in r.ids)
    assert sum(r.piece == 0 for r in rows) == 2 * docs.count()


def test_every_operator_has_its_query():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_of_the_operators(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    shown = lambda row: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(map(shown, got.select(*names).collect())) == sorted(map(shown, want.fetchall()))
