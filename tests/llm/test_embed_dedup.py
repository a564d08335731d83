import numpy as np
import pyarrow.parquet as pq

from leafspark.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.95):
    good = [i for i, (_, v, *_) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(rows[i][1]), np.float64(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = group[i], group[j]
                    group = [min(p, q) if g in (p, q) else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted((r[0], links[i], least[group[i]]) for i, r in enumerate(rows))


def got(frame, **options):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in E.embedding_groups(frame, **options).collect())


def test_matches_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in frame.collect()]
    rng = np.random.default_rng(5)
    for i in range(60):  # near copies on both sides of the threshold
        v = np.array(rows[i % 7][1])
        v = v + rng.normal(0, np.linalg.norm(v) * (0.02 + 0.008 * (i % 8)), len(v)) / 8 * 3
        rows.append((10_000 + i, [float(np.float32(x)) for x in v], None))
    rows += [(20_000 + i, rows[0][1], 1) for i in range(5)]
    want = brute(rows)
    assert sum(k for _, k, _ in want) > 20
    assert got(spark.createDataFrame(rows, SCHEMA)) == want
    assert got(spark.createDataFrame(rows, SCHEMA), chunk_floats=64 * 16, least_chunks=1) == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], None), (2, [2.0, 0.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [float("inf"), 1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.01, 0.0], 1), (11, [-1.0, 0.0, 0.0], 1), (12, [1.0], 1), (13, [3.0], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert E.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(1)
    long = rng.normal(size=3000)
    rows = [(None, [1.0, 0.0], "x", 1), (None, [1.0, 0.01], "y", 2), (5, [0.0, 1.0], None, None), (5, [0.0, 1.0], "z", None), (7, long.tolist(), "w", 0), (8, (long + rng.normal(size=3000) / 20).tolist(), "w", 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h string, node int")
    out = sorted(tuple(map(str, r)) for r in E.embedding_groups(frame).collect())
    assert out == sorted([("None", "1", "None", "True")] * 2 + [("5", "1", "5", "True")] * 2 + [("7", "1", "7", "True"), ("8", "1", "7", "False")])


def test_far_fewer_distances_than_pairs():
    """A tile finds exactly the links of brute force, and computes distances for few of the pairs."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    unit = E.unit_vectors(np.array(t.column("embedding").to_pylist()))
    rng = np.random.default_rng(2)
    unit[:200] = E.unit_vectors(unit[200:400] + rng.normal(size=(200, 64)) * 0.03)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95)) if i < j}
    found, tested = [], 0
    for a, b, n in E.join_tile(unit, np.arange(len(unit)), None, 0.95):
        found += zip(a.tolist(), b.tolist())
        tested += n
    assert len(found) == len(set(found)) and {(min(p), max(p)) for p in found} == want and len(want) >= 190
    assert tested < 0.02 * len(unit) * (len(unit) - 1) / 2
    two = [(min(a, b), max(a, b)) for x, y, _ in E.join_tile(unit, np.arange(900), np.arange(900, len(unit)), 0.95) for a, b in zip(x.tolist(), y.tolist())]
    assert sorted(two) == sorted(p for p in want if p[0] < 900 <= p[1])


def test_rotation_keeps_distances():
    v = np.random.default_rng(0).normal(size=(20, 10))
    r = E.rotate(v)
    assert np.allclose(v @ v.T, r @ r.T) and (E.rotate(v[:3]) == r[:3]).all()
