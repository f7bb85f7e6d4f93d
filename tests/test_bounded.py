import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import chunking, dense, sparse
from lodestone.operators.ranking import Best
from lodestone.plans import catalog, evaluation, passages, queries
from lodestone.plans.config import load, merge
from lodestone.sources import tables

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_vectors_are_found_like_whole_ones(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 9)), "a") for i in range(60)], "id long, text string, authority string")
    asked = dense.hashed_vectors(texts.where("id < 9"), "id", F.col("text")).withColumnRenamed("id", "query_id")
    packed = dense.packed_vectors(texts, "id", F.col("text"), ["authority"])
    assert packed.columns == ["id", "vector", "authority"]
    got = [dense.search(v, asked, 5).orderBy("query_id", "rank").collect() for v in (packed, dense.hashed_vectors(texts, "id", F.col("text")))]
    assert got[0] == got[1] and got[0]


def test_fixed_windows_need_no_exchange(spark):
    docs = catalog.paged(spark, DATA, F.col("lang").alias("title"))
    docs = docs.coalesce(1)
    made = chunking.chunk(docs, "fixed", passages.WINDOWS)
    assert plan(made).count("Exchange") <= plan(docs).count("Exchange") and "title" in made.columns


def test_chunks_and_vectors_of_hybrid_search_need_no_exchange(spark, monkeypatch):
    shuffled = {}

    def kept(df, label):
        shuffled[label] = "Exchange" in plan(df)
        return tables.written(df, label)

    monkeypatch.setattr(catalog, "_made", {})
    monkeypatch.setattr(passages, "written", kept)
    for module in (catalog, dense):  # which deals small tables over the cores
        monkeypatch.setattr(module, "spread", lambda df: df)
    passages.hybrid_retriever(spark, DATA, load(env={}))
    assert shuffled == {"passages": False, "vectors": False}


def test_filtered_hits_are_not_joined(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all pairs of queries and documents")

    monkeypatch.setattr(sparse, "scores", refused)
    assert queries.QUERIES["bm25_filtered"][0](spark, DATA).count()


def test_chunks_that_carry_their_origin_are_not_joined(spark):
    own = F.col("lang").alias("title"), F.col("source").alias("authority"), F.lit(None).cast("date").alias("publication_date"), F.lit(None).cast("string").alias("document_type")
    kept = []
    corpus = evaluation.Corpus(catalog.paged(spark, DATA, *own), keep=lambda df, _: kept.append(df) or df)
    corpus.chunks({"strategy": "fixed", "max_tokens": 64, "overlap": 8, "child_tokens": 32})
    assert "Join" not in plan(kept[0]) and {"title", "authority", "document_type"} <= set(kept[0].columns)


def test_neighbours_of_few_hits_shuffle_no_chunks(spark):
    chunks = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.floor(F.col("id") / 10).alias("document_id"), (F.col("id") % 10).cast("int").alias("position"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = chunking.neighbours(chunks, chunks.where("chunk_id IN ('c0', 'c15')").select("chunk_id"))
        assert "SortMergeJoin" not in plan(found) and found.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_holds_few_rows_of_many_queries():
    k, names = 20, pa.array(range(20_000))
    best, rng, most = Best(names, k), np.random.default_rng(1), 0
    for i in range(12):
        best.add(rng.random((50, len(names))), pa.array(range(i * 50, i * 50 + 50)))
        most = max(most, best.rows)
    assert most <= 2 * k * len(names) + 65536


def test_products_are_added_up_in_small_steps(monkeypatch):
    known = sparse._Weights(pa.table({"term": ["a", "b"] * 100, "query_id": [i // 2 for i in range(200)], "w": np.arange(200.0)}))
    doc, term, value = np.repeat(np.arange(300), 2), np.tile([0, 1], 300), np.ones(600)
    whole = known.times(doc, term, value, 300)
    monkeypatch.setattr(sparse, "PRODUCTS", 64)
    assert np.array_equal(whole, known.times(doc, term, value, 300))


def test_digests_of_words_and_pairs_are_those_of_the_library():
    words = ["", "a", "wörd", "漢字", *("x" * n for n in range(20, 70))]
    column = pa.array(["before", *words]).slice(1)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    wanted = lambda s: np.frombuffer(hashlib.md5(s.encode()).digest(), ">u4")
    assert all((got == wanted(w)).all() for got, w in zip(dense.digests([(column, np.arange(len(words)))]).T, words))
    assert all((got == wanted(f"{words[a]}_{words[b]}")).all() for got, a, b in zip(dense.digests([(column, left), (column, right)]).T, left, right))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    parts = [rng.integers(-most, most + 1, (40, 13)) * (rng.random((40, 13)) < 0.4) for most in (1, 127, 32767, 1 << 30)]
    column = pa.concat_arrays([dense.packed(x) for x in [*parts, np.zeros((2, 13), np.int64)]])
    assert np.array_equal(dense.unpacked(column.slice(5), 13), np.concatenate([*parts, np.zeros((2, 13))])[5:])
    assert dense.packed(parts[0]).nbytes < 13 * 40


def test_a_header_is_added_to_packed_vectors(spark):
    rows = [(0, "The Act says so", "EU — Law — Part 1\n"), (1, "Σίγμας ΤΕΛΟΣ word", "ΟΔΟΣ — x\n"), (2, "", "a — b\n"), (3, "one", " — \n"), (4, " ... ", "a — a\n"), (5, "two words", None), (6, None, None), (7, "b b b", "a b — b\n")]
    texts = spark.createDataFrame(rows, "id long, text string, head string")
    plain = dense.packed_vectors(texts.withColumn("lead", dense.first_word(F.col("text"))), "id", F.col("text"), ["head", "lead"], 32)
    numbers = lambda df: [dense.unpacked(pa.array([r["vector"]]), 32).tolist() for r in df.orderBy("id").collect()]
    got = numbers(dense.headed_vectors(plain, F.col("head"), F.col("lead"), ["lead"], 32))
    assert got == numbers(dense.packed_vectors(texts, "id", F.concat("head", "text"), dim=32)) and np.any(got[0]) and not np.any(got[5])


def test_texts_are_searched_and_hashed_once_for_all_steps(spark, monkeypatch):
    """The items' plan, which may hold a search, runs once; vectors under a header come from those without one."""
    hashed, runs = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(dense, "packed_vectors", lambda *a, f=dense.packed_vectors: hashed.append(a) or f(*a))
    own = F.col("lang").alias("title"), F.col("source").alias("authority"), F.lit(None).cast("date").alias("publication_date"), F.lit(None).cast("string").alias("document_type")
    corpus = evaluation.Corpus(catalog.paged(spark, DATA, *own))

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    none = F.array().cast("array<string>")
    bench = catalog._bench(spark, DATA).limit(3)
    n = bench.count()
    items = bench.mapInArrow(counted, bench.schema).select("query_id", "text", F.lit(True).alias("answerable"), F.array().cast("array<struct<document_id: string, pages: array<int>>>").alias("evidence"), F.array(F.concat(F.lit("d"), F.col("query_id").cast("string"))).alias("documents"), none.alias("ids"))
    base = merge(load(env={}), {"chunking": {"strategy": "fixed", "max_tokens": 64, "overlap": 8, "child_tokens": 32}, "retrieval": {"infer_filters": False, "type": "dense"}})
    out = evaluation.ablation(items, corpus, base, steps={"plain": {}, "headed": {"chunking": {"contextual_header": True}}}, generation=False)
    assert out.where("n = 3").count() >= 2 and runs.value == n and len(hashed) == 1
