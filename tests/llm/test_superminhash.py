import re
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from leafspark.llm import superminhash as S


def brute(rows, k, percent):
    """Components by comparing all pairs of exact shingle sets."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = [[rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None] for i in range(len(rows))]
    return [(rows[i][0], len(sets[i]), (min(ids[i]) if ids[i] else None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_matches_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = S.minhash_groups(docs, k=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in S.minhash_groups(odd, k=4).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 4, 80), key=key)
    assert S.minhash_groups(empty).count() == 0


def test_original_with_copies_that_differ_from_each_other(spark):
    """Copies at 0.8 or more to the original only: the components need the original as hub."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for at in rng.choice(200, 4, replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in S.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == {d: c for d, _, c in brute(rows, 4, 80)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(1, 2**63, 220, dtype=np.uint64)
        sig = S.signatures(np.concatenate([np.sort(pool[:200]), np.sort(pool[20:])]), np.array([0, 200, 400]))
        errors.append((sig[0] == sig[1]).mean() - 180 / 220)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.035


def test_one_row_of_each_group_stays(spark, odd):
    kept = S.drop_near_duplicates(odd, k=4)
    assert kept.columns == odd.columns
    assert kept.where(F.col("doc_id") == 2).count() + kept.where(F.col("doc_id") == 1).count() == 1
    assert kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0


def test_unrelated_texts_under_one_or_no_id_stay_and_duplicates_go(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(8)]
    near = texts[0] + " more"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (4, near), (5, texts[4]), (5, texts[5]), (9, texts[5] + " end"), (6, texts[6]), (6, texts[6]), (7, ""), (None, None), (None, "")]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = [(None, texts[1]), (4, texts[2]), (4, texts[3]), (4, near), (5, texts[4]), (5, texts[5]), (6, texts[6]), (7, ""), (None, None), (None, "")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_members_that_their_hub_does_not_link(spark, monkeypatch):
    """Families of copies around a common passage: the passage gives them a hub, and links are between other members."""
    monkeypatch.setattr(S, "CHUNK", 8)
    rng = np.random.default_rng(7)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for family in range(12):
        own = [f"f{family}_{i}" for i in range(60)]
        for copy in range(4):
            words = [*passage, *own]
            for at in rng.choice(160, 1 + copy, replace=False):
                words[at] = f"y{family}_{copy}_{at}"
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in S.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == {d: c for d, _, c in brute(rows, 4, 80)}


def test_tiles_meet_each_pair_of_groups(spark, monkeypatch):
    """Every pair of a hub's nodes in different groups shares a tile, whatever the groups' sizes; rows stay near n."""
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = [(h, int(i), int(g)) for h, sizes in enumerate([(300, 1, 1, 5), (40, 40, 40), (1, 1)]) for i, g in enumerate(np.repeat(np.arange(len(sizes)), sizes))]
    rng.shuffle(rows)
    tiles = S._tiles(spark.createDataFrame([tuple(map(int, r)) for r in rows], "hub long, node long, group long")).collect()
    met, at = set(), {}
    for t in tiles:
        at.setdefault((t.hub, t.home, t.guest), ([], []))[t.side].append((t.node, t.group))
    for (hub, _, _), (homes, guests) in at.items():
        met |= {(hub, *sorted((a, b))) for a, g in homes for b, h in guests if g != h}
    of = {(h, i): g for h, i, g in rows}
    assert met == {(h, *sorted((i, j))) for h, i, g in rows for (k, j), f in of.items() if k == h and f != g}
    assert sum(t.hub == 0 for t in tiles) <= 307 + 7 * 20


def test_clashing_columns_stay(spark):
    names = ["kept", "rows", "mark", "component", "f", "g", "node", "hub", "n", "id", "key"]
    rows = [(1, "a b c d e f", *map(str, range(11))), (2, "a b c d e f", *map(str, range(11))), (3, "x y", *map(str, range(11)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert sorted((r.doc_id, r.component_id) for r in S.minhash_groups(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


_IDLE = """
import pathlib, re
import pyarrow as pa, pyarrow.parquet as pq
from leafspark.llm import superminhash as S

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) / 1024

def batches():
    for b in pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(10_000, columns=["doc_id", "text"]):
        yield pa.RecordBatch.from_arrays([*b.columns, b.column(0)], ["doc_id", "text", "mark"])

print(sum(x.num_rows for x in S._sign(5, 240, 40)(batches())), held())
"""


def test_an_idle_worker_holds_no_memory_of_its_last_task():
    """Two workers that kept 110 MB each after signing stood beside every later stage's JVM."""
    out = subprocess.run([sys.executable, "-c", _IDLE], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 10_000
    assert float(out[1]) < 100
