import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import postings
from lodestone.operators.postings import Postings, _blocks


def test_blocks_of_a_batch_of_many_rows_and_terms():
    n, each = 10_000, 30  # rows times different terms don't fit 32 bits
    toks = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.array([f"w{i}" for i in range(n * each)]))
    runs = pa.array(["a"] * (n // 2) + ["b"] * (n // 2))
    batch = pa.RecordBatch.from_arrays([toks, pa.array([each] * n, pa.int32()), runs, pa.array(np.arange(n), pa.int32())], names=["toks", "dl", "run", "place"])
    out = pa.Table.from_batches(_blocks(iter([batch]))).to_pydict()
    got = {t: (r, p) for t, r, p in zip(out["term"], out["run"], out["places"])}
    assert len(out["term"]) == n * each and got == {f"w{i}": ("a" if i < n * each // 2 else "b", [i // each]) for i in range(n * each)}


def test_batches_of_many_terms_are_added_and_removed(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "postings"))
    n, each = 10_000, 30
    docs = spark.range(0, 2 * n, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.concat(F.lit("w"), F.translate((F.col("id") * each + i).cast("string"), "0123456789", "abcdefghij"))), " ").alias("text"))
    index.add(docs.where("id % 2 = 0"), "id", F.col("text"))
    index.add(docs.where("id % 2 = 1"), "id", F.col("text"))
    index.remove(docs.where("id = 7").select("id"))
    asked = docs.where("id IN (6, 7, 19999)").select((F.col("id") + 100).alias("query_id"), "text")
    assert {(r.query_id, r.id) for r in index.search(asked, 3).collect()} == {(106, 6), (20099, 19999)}


def test_batches_too_large_to_be_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(postings, "RUN_TOKENS", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = Postings(spark, str(tmp_path / "postings"))
        docs = spark.range(0, 60, 1, 3).select("id", F.concat(F.lit("same w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
        index.add(docs.where("id % 2 = 0 OR id % 4 = 1"), "id", F.col("text"))
        index.add(docs.where("id % 2 = 1").withColumn("text", F.concat("text", F.lit(" new"))), "id", F.col("text"))
        index.remove(docs.where("id % 7 = 3").select("id"))
        asked = docs.where("id IN (2, 3, 5)").select((F.col("id") + 100).alias("query_id"), F.split("text", " ")[1].alias("text"))
        assert {(r.query_id, r.id) for r in index.search(asked, 50).collect()} == {(102, 2), (105, 5)}
        new = spark.createDataFrame([(1, "new")], "query_id long, text string")
        assert {r.id for r in index.search(new, 50).collect()} == {i for i in range(1, 60, 2) if i % 7 != 3}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
