import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.intervals import overlapping


@pytest.mark.parametrize("width", [1, 3, 8, 1000])
def test_every_pair_once(spark, width):
    rnd = random.Random(width)

    def ranges(n):
        out = []
        for i in range(n):
            a = rnd.randint(-5, 60)
            out.append((i, rnd.choice(["x", "y", "z", None]), a, rnd.choice([a, a + 1, a + rnd.randint(0, 40), a - 1, None])))
        return out + [(n, "x", None, 4)]

    left, right = ranges(60), ranges(80)
    a = spark.createDataFrame(left, "i int, key string, lo int, hi int")
    b = spark.createDataFrame(right, "j int, key string, first int, last int")
    got = sorted((r.i, r.j) for r in overlapping(a, b, ["key"], ("lo", "hi"), ("first", "last"), width).collect())
    ok = lambda x, y: x is not None and y is not None and x <= y
    want = sorted((i, j) for i, k, lo, hi in left for j, m, first, last in right if k is not None and k == m and ok(lo, hi) and ok(first, last) and lo <= last and first <= hi)
    assert got == want and got


def test_a_document_of_many_chunks_is_split(spark):
    """A hundred thousand chunks of one document: no bin, and so no task, has more than a few."""
    chunks = spark.range(100_000).select(F.lit("d").alias("key"), F.col("id").alias("first"), (F.col("id") + 1).alias("last"))
    one = spark.createDataFrame([("d", 500, 503)], "key string, lo int, hi int")
    assert overlapping(one, chunks, ["key"], ("lo", "hi"), ("first", "last")).count() == 5
    bins = chunks.select(F.explode(F.sequence(F.floor(F.col("first") / 8), F.floor(F.col("last") / 8))).alias("bin"))
    assert bins.groupBy("bin").count().agg(F.max("count")).first()[0] <= 9
