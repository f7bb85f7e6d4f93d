import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroids as cc


def plain(rows, k, rounds):
    """Every distance of every vector to every centroid."""
    import hashlib

    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    cs = [v for _, _, v in sorted((digest(i), v, v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, owner) if o == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v)[1], near(v)[0], ",".join(map(str, cs[near(v)[1]]))) for i, v in kept]
    total = sum(d for _, _, d, _ in out)
    return sorted(((i, c, d, sum(e for _, f, e, _ in out if f == c), total, s) for i, c, d, s in out), key=str)


def got(found):
    return sorted((tuple(r) for r in found.drop("n_exact").collect()), key=str)


def rows(n, seed):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    out = [(i, [float(np.float32(m + rnd.gauss(0, 0.2))) for m in rnd.choice(middles)]) for i in range(n)]
    out += [(i, list(out[0][1])) for i in range(n, n + n // 3)]  # a third are copies of one
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (None, [0.5] * 64), (906, [0.0] * 64), (907, [-0.0] * 64)]
    return out + odd


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("n,k,rounds,seed", [(120, 8, 5, 1), (40, 40, 3, 2), (3, 40, 2, 3)])
def test_equals_all_distances(spark, n, k, rounds, seed):
    data = rows(n, seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert got(cc.cluster(df, k, rounds)) == plain(data, k, rounds)


def test_screening_prunes_and_keeps_the_nearest():
    rnd = np.random.default_rng(5)
    middles = rnd.integers(-900, 900, (40, 64)) * (rnd.random((40, 64)) < 0.2)
    x = middles[rnd.integers(0, 40, 3000)] + rnd.integers(-9, 10, (3000, 64))
    cluster, distance, seen = cc.nearest(x, cc.segment_norms(x).astype(np.float32), middles)
    every = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen.mean() < 4  # of 40


def test_ties_take_the_smaller_number():
    c = np.array([[4, 0, 0, 0], [0, 4, 0, 0], [4, 0, 0, 0]])
    x = np.array([[4, 0, 0, 0], [2, 2, 0, 0], [0, 0, 0, 0]])
    assert cc.nearest(x, cc.segment_norms(x).astype(np.float32), c)[0].tolist() == [0, 0, 0]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cc.cluster(none, 40, 5).collect() == []
    clash = spark.createDataFrame([("a", [1.0] * 64, 1, 2, "x"), ("b", [0.0] * 64, 3, 4, "y")], "vec_id string, embedding array<double>, cluster int, id int, `a.b c` string")
    assert {(r.vec_id, r.distance) for r in cc.cluster(clash, 2, 1).collect()} == {("a", 0), ("b", 0)}
    unnamed = spark.createDataFrame([(None, [1.0] * 64)] * 2, SCHEMA)
    assert [(r.cluster, r.distance) for r in cc.cluster(unnamed, 2, 1).collect()] == [(0, 0)] * 2
    with pytest.raises(Exception, match="more than 26 bits"):
        cc.cluster(spark.createDataFrame([(1, [1e30] + [0.0] * 63)], SCHEMA), 2, 1).collect()


def test_query_equals_the_operator(spark, tmp_path):
    data = rows(150, 7)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = cc.op13_centroids(spark, str(tmp_path))
    want = spark.createDataFrame(plain(data, 40, 5), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, s string").withColumn("s", F.sha2("s", 256))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect())))
