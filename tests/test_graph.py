import random

import pytest

from melisma.operators.graph import components, spanning_forest


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("one_task", [1_000_000, 3])
def test_components_and_forest(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(None, 4), (7, None), (9, 9)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 301 + i) for i in range(20)]
    want = plain(edges)
    roots, forest = spanning_forest(spark.createDataFrame(edges, "src long, dst long"), one_task=one_task)
    assert {r["node"]: r["root"] for r in roots.collect()} == want
    kept = [(r["src"], r["dst"]) for r in forest.collect()]
    assert len(kept) == len(want) - len(set(want.values())) and plain(kept) == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
