import random

from lodestone.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_shapes(spark):
    rnd = random.Random(6)
    path = [(i, i + 1) for i in range(200)]
    mixed = list(range(1000, 1200))
    rnd.shuffle(mixed)
    star = [(2999, i) for i in range(2000, 2100)]
    edges = path + list(zip(mixed, mixed[1:])) + star + [(5000 + rnd.randint(0, 300), 5000 + rnd.randint(0, 300)) for _ in range(150)] + [(-5, -9), (-9, -7), (-5, -9)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_none(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
