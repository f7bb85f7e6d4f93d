import random

from lodestone.operators import cells, dense


def vectors(spark, n, seed=1, dim=12, spread=0.15):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [m + rnd.gauss(0, spread) for m in rnd.choice(middles)]) for i in range(n)]
    rows += [(n, [0.0] * dim), (n + 1, None), (None, [1.0] * dim), (n + 2, list(rows[0][1])), (n + 3, [-x for x in rows[0][1]])]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def hits(found):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())


def test_exact_search_equals_the_scan_and_reads_less(spark, tmp_path):
    v = vectors(spark, 2000).repartition(4)
    index = cells.CellIndex(spark, str(tmp_path / "i"))
    index.build(v, cells=24)
    q = v.where("id % 40 = 0 OR id >= 2000").selectExpr("id AS query_id", "vector")
    for k, probe in ((1, 1), (10, 3), (300, 2)):
        assert hits(index.search(q, k, probe)) == hits(dense.search(v, q, k))
    near = hits(index.search(q, 10, 3, exact=False))
    every = hits(dense.search(v, q, 10))
    assert len({(a, c) for a, _, c, _ in near} & {(a, c) for a, _, c, _ in every}) / len(every) >= 0.9
    read = []
    rows = index._rows
    index._rows = lambda names, schema: read.append(set(names)) or rows(names, schema)
    index.search(q.where("query_id = 40"), 10, 2).collect()
    assert len(read[0]) == 2 and len(set().union(*read)) <= 12  # of 24: other groups of vectors can't hold a hit


def test_few_rows_and_no_queries(spark, tmp_path):
    v = vectors(spark, 3)
    index = cells.CellIndex(spark, str(tmp_path / "i"))
    index.build(v, cells=24)
    assert hits(index.search(v.selectExpr("id AS query_id", "vector").where("query_id < 3"), 9)) == hits(dense.search(v, v.selectExpr("id AS query_id", "vector").where("query_id < 3"), 9))
    assert index.search(v.selectExpr("id AS query_id", "vector").where("false"), 9).collect() == []
