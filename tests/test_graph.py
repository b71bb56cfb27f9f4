"""Components of random graphs against union-find."""

from __future__ import annotations

import random

from quoin.operators.graph import connected_components


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2000)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {k: find(k) for k in {*root, 3}}  # a node without a partner is its own component
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
