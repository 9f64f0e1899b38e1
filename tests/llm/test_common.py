import random

import pytest

from ripplet.llm import common


def slow(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent if root(x) != x}


@pytest.mark.parametrize("links_a_task", [200_000, 300])
def test_components(spark, monkeypatch, links_a_task):
    monkeypatch.setattr(common, "LINKS_A_TASK", links_a_task)
    rng = random.Random(1)
    edges = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(800)]  # random links
    edges += [(i, i + 1) for i in range(3000, 3100)] + [(5000, 5000 + i) for i in range(600)]  # a path and a star
    edges += [(-7, 4), (5, 5), (None, 3), (3, None), edges[0], edges[0][::-1]]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == slow(edges) and len(got) == len(slow(edges))


def test_components_of_nothing(spark):
    for edges in ([], [(1, 1)], [(None, None)]):
        assert common.components(spark.createDataFrame(edges, "a long, b long")).count() == 0
