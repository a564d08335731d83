import random

import pytest

from leafspark.llm import components as C


def brute(edges):
    """The least node of each node's component, one edge after the other."""
    edges = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    least = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((least[a], least[b]))
        least = {x: low if y == high else y for x, y in least.items()}
    return least


def graphs():
    deal = random.Random(7)
    path = list(range(400))
    deal.shuffle(path)
    return {
        "path": list(zip(path, path[1:], strict=False)),
        "hub": [(900, x) for x in range(300)] + [(x, 901) for x in range(299, 600)],
        "random": [(deal.randrange(-300, 300), deal.randrange(-300, 300)) for _ in range(280)],
        "odd": [(None, 1), (1, None), (2, 2), (5, 4), (4, 5), (5, 4), (2**63 - 1, -(2**63)), (5, 9)],
        "empty": [],
    }


def found(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long").repartition(8)
    rows = [tuple(r) for r in C.connected_components(table).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("alone", [0, 150, C.TASK_EDGES])
def test_matches_brute_force(spark, monkeypatch, alone):
    """By rounds over all tasks, by one task, and by whichever the number of edges asks for."""
    monkeypatch.setattr(C, "TASK_EDGES", alone)
    for name, edges in graphs().items():
        assert found(spark, edges) == brute(edges), name


@pytest.fixture
def written(monkeypatch):
    tables = []
    write = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: tables.append(df) or write(df))
    return tables


def test_small_tables_need_no_rounds(spark, written):
    """op2 on a table with groups of copies spent a third of its time in rounds over a few thousand edges."""
    edges = graphs()["path"]
    assert found(spark, edges) == brute(edges)
    assert len(written) <= 2


def test_rounds_end_when_every_node_has_its_root(spark, monkeypatch, written):
    monkeypatch.setattr(C, "TASK_EDGES", 0)
    edges = [(x, x % 3) for x in range(3, 300)]
    assert found(spark, edges) == brute(edges)
    assert len(written) == 1
