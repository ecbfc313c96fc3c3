import random

import pytest

from quillstore.llm import graph


@pytest.mark.parametrize("few", [0, 40, 50_000])
def test_components_against_a_plain_version(spark, monkeypatch, few):
    """A star, a long chain, random links, and none; by rounds, by rounds and a last task, and by one task."""
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1000, 1025)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(70)] + [(7, 7), (-9, 3000), (3000, -9)]
    r.shuffle(edges)
    parent: dict[int, int] = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
