"""Depth of descent without a cap, against breadth-first search."""

import random
from collections import deque

import pytest

from inkfield.operators import graph, skew


def depths(edges):
    down = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            down.setdefault(a, set()).add(b)
    children = {b for bs in down.values() for b in bs}
    out = {}
    for root in set(down) - children:
        far, queue = {root: 0}, deque([root])
        while queue:
            at = queue.popleft()
            for b in down.get(at, ()):
                if b not in far:
                    far[b] = far[at] + 1
                    queue.append(b)
        out[root] = max(far.values())
    return out


@pytest.mark.parametrize("shape", ["chain", "trees", "hub", "cycle below none", "two parents", "cycles", "empty"])
def test_depths_equal_a_search(spark, monkeypatch, shape):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(150)] + [(1_000, 1_001), (7, 7), (None, 3), (4, None)],
        "trees": [(rng.randrange(max(1, i - 20), i), i) for i in range(2, 200)] + [(500, 501)] * 2,
        "hub": [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(101, 300 + i) for i in range(40)],
        "cycle below none": [(1, 2), (2, 3), (3, 1), (3, 4), (10, 11)],
        "two parents": [(i, i + 2) for i in range(12)] + [(i, i + 3) for i in range(12)],
        "cycles": [(1, 2), (2, 3), (3, 2), (3, 4), (9, 4), (4, 5)],
        "empty": [],
    }[shape]
    got = graph.descent_depth(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["root"]: r["depth"] for r in got.collect()} == depths(edges)
