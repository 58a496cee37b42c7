"""Components against a union-find."""

import random

import pytest

from tessera.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in edges:
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


RNG = random.Random(2)
GRAPHS = {
    "path": [(i, i + 1) for i in range(300)],
    "star of the largest": [(9999, i) for i in range(200)],
    "random": [(RNG.randrange(400), RNG.randrange(400)) for _ in range(230)],
    "loops and repeats": [(1, 2), (2, 1), (1, 2), (7, 7)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = spark.createDataFrame(GRAPHS[name], "a long, b long")
    assert dict(map(tuple, connected_components(edges).collect())) == brute(GRAPHS[name])


def test_null_ends_are_ignored(spark):
    assert connected_components(spark.createDataFrame([(None, 3), (4, None)], "a long, b long")).count() == 0
