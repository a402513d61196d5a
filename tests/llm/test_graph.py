"""Components by stars, by one task and by both, against a plain search."""

import random

import pytest

from flowloom.llm.graph import components


def search(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for x in sorted(near):
        todo = [] if x in root else [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += near[y]
    return sorted(root.items())


@pytest.mark.parametrize("local", [0, 30, 1 << 16])
def test_components(spark, local):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(500, 500 + k) for k in range(60)] + [(7, 7), (3, 9), (9, 3)]
    got = sorted((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), local=local).collect())
    assert got == search(edges)


@pytest.mark.parametrize("local", [0, 1 << 16])
def test_digests_and_nothing(spark, local):
    edges = [(bytes([k]), bytes([k // 2])) for k in range(200, 256)]
    got = sorted((bytes(r.node), bytes(r.root)) for r in components(spark.createDataFrame(edges, "a binary, b binary"), local=local).collect())
    assert got == search(edges)
    assert components(spark.createDataFrame([], "a long, b long"), local=local).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), local=local).collect() == []
