import random

import pytest

from tidewell.llm.components import components


def slow(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_against_union_find(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(150)] + [(500, 500), (None, 3), (4, None)],
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(220)],
        "empty": [(1, 1)],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == slow(edges)
