import json
import os
import random
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import metrics, postings, sparse
from lodestone.sources import stores
from lodestone.sources.snapshots import Changed
from lodestone.streaming import latency, traces


def test_vector_table(spark, tmp_path):
    t = stores.VectorTable(spark, str(tmp_path / stores.collection_name("Reg", "section", "bge/small", 2, True)))
    assert "reg_section_bge_small_ctx_v2" in t.path and not t.healthy()
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, vector array<double>")
    t.recreate(rows)
    t.upsert(spark.createDataFrame([("b", [3.0]), ("c", [4.0])], rows.schema))
    assert {r.chunk_id: r.vector for r in t.scan().collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]} and t.count() == 3 and t.healthy()
    t.recreate(rows.where("chunk_id = 'a'"))
    assert [r.chunk_id for r in t.scan().collect()] == ["a"] and t.count() == 1
    t.upsert(spark.createDataFrame([("a", [7.0]), ("a", [8.0]), ("a", [9.0])], rows.schema))
    seen = {tuple(r.vector) for _ in range(3) for r in t.scan().collect()}
    assert len(seen) == 1 and t.count() == 1  # of rows of one id in a batch, the same one stays in every read
    t.recreate(t.scan().select("chunk_id", "vector"))
    assert {tuple(r.vector) for r in t.scan().collect()} == seen


def test_writers_at_once_and_readers_of_a_version(spark, tmp_path):
    t = stores.VectorTable(spark, str(tmp_path / "c"))
    batch = lambda i: spark.createDataFrame([(f"k{i}", [float(i)]), ("shared", [float(i)])], "chunk_id string, vector array<double>")
    t.recreate(batch(0))
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: stores.VectorTable(spark, t.path).upsert(batch(i)), range(1, 7)))
    assert sorted(versions) == list(range(2, 8))  # none lost, none overwritten
    assert {r.chunk_id for r in t.scan().collect()} == {"shared", *(f"k{i}" for i in range(7))}
    last = versions.index(7) + 1
    assert t.scan().where("chunk_id = 'shared'").first().vector == [float(last)]
    reader = t.scan()
    t.recreate(batch(9))
    assert reader.count() == 8 and t.count() == 2  # a reader keeps the version that it began with
    assert t.scan(7).count() == 8
    t.upsert(batch(10))
    t.compact()
    assert t.count() == 3 and len(t.versions.entries()[1]) == 1
    old = t.versions.entries()[0]
    t.upsert(batch(11))
    with pytest.raises(Changed):
        t.versions.commit(lambda entries: entries, old)


def test_postings_equal_the_scan(spark, tmp_path):
    rnd = random.Random(2)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "se") for b in ("na", "ti", "po", "dde", "x", "qui")]
    text = lambda: " ".join(rnd.choice(words) if rnd.random() < 0.7 else "common" for _ in range(rnd.choice([0, 1, 5, 30])))
    first = [(i, text()) for i in range(300)] + [(None, "ka lona"), (7000, None)]
    second = [(i, text()) for i in range(250, 420)]  # fifty of the first take new texts
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = postings.Postings(spark, str(tmp_path / "i"), run_documents=20)
    index.add(frame(first), "doc_id", F.col("text"))
    index.add(frame(second), "doc_id", F.col("text"))
    index.remove(spark.createDataFrame([(i,) for i in range(0, 400, 9)] + [(99999,)], "id long"))
    left = [(i, t) for i, t in first if i is None or i >= 7000 or i < 250] + second
    left = [(i, t) for i, t in left if not (i is not None and i < 400 and i % 9 == 0)]
    plain = sparse.build(frame(left), "doc_id", F.col("text"))
    assert index.index().size == plain.size == len(left) and abs(index.index().mean_length - plain.mean_length) < 1e-12
    stats = lambda x: {r.term: (r.df, round(r.idf, 9)) for r in x.terms.collect()}
    assert stats(index.index()) == stats(plain)
    q = spark.createDataFrame([(1, "kana lona lona"), (2, "common"), (3, "mipo sex nothing"), (4, ""), (5, "absent"), (6, " ".join(words))], "query_id int, text string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    for k in (1, 3, 50):
        assert rows(index.search(q, k)) == rows(sparse.search(plain, q, k))
    # a search lists and reads the folders of its terms alone
    one = [x[0] for x in spark.createDataFrame([("kana",)], "t string").select(postings.bucket_of(F.col("t"))).collect()]
    files = index.blocks(one).inputFiles()
    assert files and all(f"/bucket={one[0]}/" in f for f in files) and len(files) < len(index.blocks(list(range(postings.BUCKETS))).inputFiles()) / 5


def test_cache_computes_misses_once(spark):
    rows = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    cache = rows.where("text = 'x'").select(stores.cache_key(F.lit("m"), F.col("text")).alias("key"), F.lit(7).alias("value"))
    out, fresh = stores.cached(rows, cache, "m", "text", lambda miss: miss.select("key", F.length("text").alias("value")))
    assert sorted((r.text, r.value) for r in out.collect()) == [("x", 7), ("y", 1), ("y", 1)] and fresh.count() == 1


def test_eval_items(spark, tmp_path):
    rows = [
        {"id": "1", "question": "q", "answerable": True, "relevant_evidence": [{"document_id": "b", "pages": [1]}, {"document_id": "a", "pages": [2]}, {"document_id": "b", "pages": [3]}]},
        {"id": "2", "question": "q", "answerable": True}, {"id": "4", "question": "q", "answerable": False, "question_type": "riddle", "difficulty": "odd"}, {"id": "3", "question": "q", "answerable": False}, {"id": "3", "question": "q", "answerable": False},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    items, problems = stores.eval_items(spark, str(tmp_path / "e.jsonl"))
    assert items.where("id = '1'").first().relevant_document_ids == ["a", "b"]
    assert {(r.id, r.problem) for r in problems.collect()} == {("2", "answerable without ground truth"), ("3", "duplicate id"), ("4", "unknown question type"), ("4", "unknown difficulty")}
    assert items.where("id = '1'").first().question_type == "factual"


def test_jsonl_and_listing(spark, tmp_path):
    row = dict.fromkeys([c.split()[0] for c in stores.CHUNK_SCHEMA.split(", ")])
    chunks = spark.createDataFrame([tuple((row | {"chunk_id": f"d:{i}", "document_id": "d", "title": f"t{i}", "position": i, "page_end": i + 1}).values()) for i in range(3)], stores.CHUNK_SCHEMA)
    stores.write_jsonl(chunks, str(tmp_path / "c"))
    stores.write_jsonl(chunks.limit(1), str(tmp_path / "c"), append=True)
    back = stores.read_jsonl(spark, str(tmp_path / "c"), stores.CHUNK_SCHEMA)
    d = stores.documents(back).first()
    assert (d.chunks, d.pages, d.title) == (4, 3, "t0")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 4}T0{i % 9}:00:00", "query" if i % 3 else "error", float(i)) for i in range(40)] + [("2024-02-01T00:00:00", "query", 1.0)]
    schema = "ts timestamp, event_type string, value double"
    batch = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    stores.write_jsonl(batch, str(tmp_path / "traces"))
    stream = traces.windowed(traces.read_traces(spark, str(tmp_path / "traces"), schema))
    traces.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = {tuple(r) for r in traces.windowed(batch).where("window_start < '2024-01-30'").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_entry_imports_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "lodestone"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for name in os.listdir(f"{root}/lodestone"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/lodestone/{name}", tmp_path / "lodestone" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); sys.path[:] = [p for p in sys.path if p not in ('', {root!r})]; s.loader.exec_module(m); q = m.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_latest_latencies_as_a_stream(spark, tmp_path):
    """Batches with late rows and a restart in between: as over the whole table."""
    rnd = random.Random(5)
    moments = rnd.sample(range(100_000), 900)
    rows = [(f"2024-01-01T00:0{m // 60_000}:{m // 1000 % 60:02d}.{m % 1000:03d}", rnd.choice(["ask", "search", "rare"] if i % 90 == 0 else ["ask", "search"]), rnd.random() * 9) for i, m in enumerate(moments)]
    kind = "ts timestamp, event_type string, value double"
    stream = lambda: latency.latest_latencies(traces.read_traces(spark, str(tmp_path / "in"), kind), "ts", "event_type", "value", 100)
    for at in range(0, 900, 300):
        part = spark.createDataFrame(rows[at : at + 300] + [(None, "ask", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        stores.write_jsonl(part, str(tmp_path / "in"), append=True)
        latency.run_to_latest(stream(), "event_type", str(tmp_path / "out"), str(tmp_path / "state"))
        got = {r.event_type: (r.requests, r.p50, r.p95) for r in latency.latest_of(spark.read.parquet(str(tmp_path / "out")), "event_type").collect()}
        whole = spark.createDataFrame(rows[: at + 300], "ts string, event_type string, value double")
        window = Window.partitionBy("event_type").orderBy(F.desc("ts"))
        last = whole.withColumn("n", F.row_number().over(window)).where("n <= 100").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.collect_list("value").alias("v"))
        want = {r.event_type: (r.requests, r.p50, r.p95) for r in last.select("event_type", "requests", metrics.service_percentile(F.col("v"), 0.5).alias("p50"), metrics.service_percentile(F.col("v"), 0.95).alias("p95")).collect()}
        assert got == want and got["ask"][0] == min(100, got["ask"][0])
