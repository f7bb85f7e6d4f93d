import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as module
from lodestone.llm.exact_dedup import distinct_texts, exact_dedup
from lodestone.llm.sqltext import lower_ascii
from lodestone.llm.store import materialize, scratch

from .conftest import frame, near_copies

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_groups_and_survivors(spark):
    texts = near_copies(120, 1, edits=1) + [(200, "É"), (201, "é"), (202, "ABC"), (203, "abc"), (204, "ab" + "x" * 70), (205, "ab" + "x" * 69 + "y"), (206, None), (207, "")]
    want = brute(texts)
    got = exact_dedup(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.keep_id)
    assert {r.text for r in got} == {t for _, t in texts}


def test_odd_rows(odd):
    got = exact_dedup(odd)
    assert [c for c in odd.columns if c != "kept"] + ["keep_id", "group_size", "kept"] == got.columns
    rows = got.collect()
    assert len(rows) == 11
    alpha = [r for r in rows if (r.text or "").lower().startswith("alpha")]
    assert {r.keep_id for r in alpha} == {5} and sum(r.kept for r in alpha) == 1
    nulls = [r for r in rows if r.doc_id is None]
    assert [r.group_size for r in nulls] == [2, 2] and sum(r.kept for r in nulls) == 1 and all(r.keep_id is None for r in nulls)
    empty = {r.doc_id: r for r in rows if r.doc_id in (1, 2)}
    assert empty[1].keep_id == 2 and not empty[1].kept and empty[2].kept


def test_empty_table(none):
    assert exact_dedup(none).count() == 0


def shuffled(spark):
    """20,000 rows of 5,000 texts that come out of a join, with columns that only the result reads."""
    left = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 5000).cast("string")).alias("text"))
    right = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), (F.col("id") * 3).alias("more"))
    return left.join(right.hint("merge"), "doc_id")


def test_rows_of_a_join_keep_their_numbers(spark, tmp_path):
    for columns in (["doc_id", "text", "wide", "more"], ["doc_id"]):
        exact_dedup(shuffled(spark), carry=columns).write.mode("overwrite").parquet(str(tmp_path / "out"))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == 20_000 and got.where("kept").count() == 5_000
        assert got.where("kept AND doc_id < 15000").count() == 0
    distinct_texts(shuffled(spark)).write.parquet(str(tmp_path / "distinct"))
    got = spark.read.parquet(str(tmp_path / "distinct"))
    assert got.columns == ["doc_id", "text", "wide", "more"]
    assert got.count() == 5_000 and got.select("text").distinct().count() == 5_000


def test_distinct_texts_by_shuffle_and_by_broadcast(spark, odd, none, monkeypatch):
    want = sorted(map(str, exact_dedup(odd).where("kept").select("doc_id", "text").collect()))
    for most in (1_000_000, 0):
        monkeypatch.setattr(module, "MOST_DROPPED", most)
        got = distinct_texts(odd)
        assert got.columns == odd.columns
        assert sorted(map(str, got.select("doc_id", "text").collect())) == want
    assert distinct_texts(none).count() == 0


def test_names_with_dots_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "X y", 1, 2), ("b", "x Y", 3, 4), ("c", "z", 5, 6)], "doc_id string, text string, `n.chars` long, `_a b` long")
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert got["a"].keep_id == "b" and got["b"].kept and got["c"].group_size == 1 and got["b"]["n.chars"] == 3
    assert sorted(r["doc_id"] for r in distinct_texts(docs).collect()) == ["b", "c"]


def test_written_tables_go(spark, odd):
    with scratch() as keep:
        out = materialize(exact_dedup(odd), "result")
        keep.append(out)
        inner = materialize(out, "other")
    assert out.count() == 11
    with pytest.raises(Exception):
        inner.count()


def test_contract_query_hash(spark):
    texts = [(1, "ÀÉ abc DEF"), (2, "ABC xyz"), (3, "ß İ K")]
    got = {r[0]: r[1] for r in frame(spark, texts).select("doc_id", F.sha2(lower_ascii(F.col("text")), 256)).collect()}
    assert got == {i: hashlib.sha256(t.translate(FOLD).encode()).hexdigest() for i, t in texts}
