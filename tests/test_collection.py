"""From pages to answers over a collection that grows."""

import datetime

from pyspark.sql import functions as F

from lodestone.plans import ingestion, retrieval
from lodestone.plans.config import load, merge

FILLER = "Nothing else is known about this place; it is quiet and old, and nobody has written of it for years."


def pages(spark, docs):
    rows = [(d, n, f"Gazette\n{text}\n{FILLER}" if text else "") for d, texts in docs.items() for n, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id string, page_number int, text string")


def origin(spark, docs):
    rows = [(d, i, d.upper(), "EBA" if i % 2 else "ECB", datetime.date(2020, 1, 1 + i)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "document_id string, doc_order int, title string, authority string, publication_date date")


def test_two_ingestions_and_answers(spark, tmp_path):
    settings = merge(load(env={}), {"chunking": {"max_tokens": 60, "overlap": 5}, "retrieval": {"filter_mode": "restrict"}, "pricing": {"extractive": {"input": 2.0, "output": 10.0}}})
    first = {"a": ["Ships anchor in the outer harbour while storms last.", "Pilots meet them before sunrise."], "b": ["Carts cross the northern bridge in spring."], "copy": ["Ships anchor in the outer harbour while storms last.", "Pilots meet them before sunrise."], "empty": [""]}
    store = ingestion.Collection(spark, str(tmp_path / "c"))
    failed = spark.createDataFrame([("broken", "ValueError: no")], "document_id string, error string")
    chunks, report = ingestion.ingest(pages(spark, first), origin(spark, first), settings, store, failed)
    r = report.first()
    assert (r.documents, r.duplicate_documents, r.pages_processed, r.near_empty_pages, r.failed_pages, r.pages_kept, r.empty_documents) == (4, 1, 4, 1, 1, 3, 1)
    assert (r.documents_processed, r.documents_failed, r.chunks_generated) == (2, 1, chunks.count())
    second = {"c": ["Millers grind barley behind the western wall."], "b": ["Carts cross the southern ford in spring."]}
    ingestion.ingest(pages(spark, second), origin(spark, second), settings, store)
    assert store.vectors.count() == store.chunks().count() == store.postings.index().size
    assert {x.document_id for x in store.chunks().collect()} == {"a", "b", "c"}
    q = spark.createDataFrame([(1, "Where do ships anchor while storms last?"), (2, "Who grinds barley behind the western wall?"), (3, "What crosses the southern ford in spring says the EBA?"), (4, "Which zebras juggle copper lanterns?"), (5, "Where do ships anchor says the EBA?")], "query_id long, text string")
    out, traces = retrieval.respond(q, store.retriever(settings), store.chunks(), settings)
    got = {x.query_id: x for x in out.collect()}
    assert [[s.document_id for s in got[i].sources] for i in (1, 2, 3)] == [["a"], ["c"], ["b"]] and got[3].sources[0].authority == "EBA" and got[4].insufficient
    assert got[5].insufficient and not any(x.id.startswith("a:") for x in got[5].retrieved)  # a is the ECB's
    assert abs(got[1].cost - (got[1].prompt_tokens * 2 + got[1].completion_tokens * 10) / 1e6) < 1e-12 and got[1].prompt_tokens > 0
    kept = {x.request_id: x for x in traces.collect()}
    assert set(kept) == {"1", "2", "3", "4", "5"} and kept["1"].retrieved_chunk_ids == [x.id for x in got[1].retrieved] and kept["1"].retrieval_strategy == "hybrid"


def test_spans_with_a_broken_file(spark):
    line = lambda t, size: [{"text": t, "size": size, "flags": 0, "font": "Serif"}]
    kind = "document_id string, page_number int, block int, line int, spans array<struct<text: string, size: double, flags: int, font: string>>, error string"
    rows = [("good", p, b, b, line(t, s), None) for p in (1, 2) for b, (t, s) in enumerate([(f"Heading {'one' if p == 1 else 'two'}", 15.0), (f"Ships anchor in the outer harbour while storm number {p} lasts. {FILLER}", 10.0)])]
    spans = spark.createDataFrame([*rows, ("bad", None, None, None, None, "ValueError: encrypted")], kind)
    docs = spark.createDataFrame([("good", 0, "G"), ("bad", 1, "B")], "document_id string, doc_order int, title string")
    chunks, report = ingestion.ingest_spans(spans, docs, load(env={}), None)
    r = report.first()
    assert (r.documents_processed, r.documents_failed, r.pages_kept) == (1, 1, 2)
    assert {x.section for x in chunks.collect()} <= {"Heading one", "Heading two", None} and chunks.where(F.col("text").contains("storm number 2")).count() == 1
