"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from leafspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(int(value)) if isinstance(value, bool) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert len(a) == len(b)
    numbers = lambda x, y: x.replace(".", "").replace("-", "").isdigit() and y.replace(".", "").replace("-", "").isdigit() and abs(float(x) - float(y)) <= 1e-5 * max(1, abs(float(y)))
    wrong = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or numbers(p, q) for p, q in zip(x, y))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert catalog.flagship(spark, SF).limit(1).count() == 1
