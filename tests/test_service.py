import io
import json
import logging
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import grounding, metrics
from lodestone.plans import retrieval, service
from lodestone.plans.config import load
from lodestone.sources import stores


def test_ingestion_needs_leave_and_runs_alone():
    gate, allowed = service.IngestGate(), {service.ALLOW: "1"}
    with pytest.raises(service.Refused) as e:
        gate.run(lambda: 1, {})
    assert e.value.status == 403
    begun, go = threading.Event(), threading.Event()
    one = threading.Thread(target=lambda: gate.run(lambda: (begun.set(), go.wait(10)), allowed))
    one.start()
    begun.wait(10)
    with pytest.raises(service.Refused) as e:
        gate.run(lambda: 1, allowed)
    assert e.value.status == 409
    go.set()
    one.join()
    assert gate.run(lambda: 7, allowed) == 7
    with pytest.raises(KeyError):
        gate.run(lambda: {}["x"], allowed)
    assert gate.run(lambda: 8, allowed) == 8  # a failed one doesn't keep the gate shut


def test_errors_have_statuses_and_hide_what_is_unexpected():
    class Down(service.StoreUnavailable):
        pass

    assert [service.error_reply(x)[0] for x in (Down("secret"), service.ModelFailed(), service.EmbeddingFailed(), service.Refused(409, "busy"), ValueError("secret"))] == [503, 502, 502, 409, 500]
    assert not any("secret" in str(service.error_reply(x)[1]) for x in (Down("secret"), ValueError("secret")))


def test_events_are_json_lines():
    out = io.StringIO()
    service.log_as_json(logging.StreamHandler(out))
    with service.request("r1") as id_:
        service.event("asked", n=3, path=service)
    service.event("idle")
    service.error_reply(RuntimeError("no"))
    first, second, third = map(json.loads, out.getvalue().splitlines())
    assert id_ == "r1" and first["event"] == "asked" and first["n"] == 3 and first["request_id"] == "r1" and first["level"] == "INFO"
    assert "request_id" not in second and third["error"] == "RuntimeError: no" and third["level"] == "ERROR"


def test_health_and_metrics(spark, tmp_path):
    store = stores.VectorTable(spark, str(tmp_path / "c"))
    assert service.health(None, None)[0] == 503 and service.health(store, spark.range(3))[1]["vector_store"] is False
    store.recreate(spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>"))
    assert service.health(store, spark.range(3)) == (200, {"status": "ok", "index_loaded": True, "vector_store": True, "chunks": 3})
    rows = spark.createDataFrame([("ask", i, float(i)) for i in range(1, 12)], "kind string, at int, value double")
    table = service.latencies(rows, "at", "kind")
    assert service.prometheus(table).splitlines() == ['lodestone_requests{kind="ask"} 11', 'lodestone_p50{kind="ask"} 6.0', 'lodestone_p95{kind="ask"} 11.0']


def test_quantiles_over_ordered_bins(spark):
    import random
    import statistics

    rnd = random.Random(4)
    groups = {"a": [rnd.gauss(0, 5) for _ in range(700)], "b": [float(rnd.choice([1, 2, 2, 9])) for _ in range(400)], "c": [3.5], "d": [1.0, 4.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("e", None)], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in metrics.exact_quantiles(rows, "k", "v").collect()}
    want = {k: (len(v), *((round(statistics.quantiles(v, n=100)[p - 1], 6) if len(v) > 1 else v[0]) for p in (50, 95))) for k, v in groups.items()}
    assert got == want


def test_the_model_is_not_asked_without_context(spark):
    asked = []
    hits = spark.createDataFrame([("q1", 1, "c1", "some text of the evidence", "d", 1, 1, None, "T", "A", None, None, None)], "query_id string, rank int, id string, text string, document_id string, page_start int, page_end int, section string, title string, authority string, publication_date date, parent_id string, parent_text string")
    questions = spark.createDataFrame([("q1", "what text?"), ("q2", "nothing is found for this")], "query_id string, text string")

    def model(shown, wanted):
        asked.extend(r.query_id for r in wanted.collect())
        return wanted.select("query_id", F.lit("An answer.").alias("answer"), F.lit("c1").alias("cited"), F.lit(False).alias("insufficient"))

    got = {r.query_id: r for r in retrieval.answer(hits, questions, hits.select("id"), load(env={}), model).collect()}
    assert asked == ["q1"] and got["q1"].answer == "An answer." and got["q1"].citations == ["c1"]
    assert got["q2"].answer == grounding.INSUFFICIENT and got["q2"].insufficient and got["q2"].citations == [] and got["q2"].context_tokens == 0


def test_a_tokenizer_of_ones_own(spark):
    df = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    pairs = tx.token_counter(lambda texts: [len(t) // 2 for t in texts])
    assert [r.n for r in df.select(pairs(F.col("t")).alias("n")).collect()] == [6, 0, None]
