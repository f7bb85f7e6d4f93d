"""python -m lodestone COMMAND: the plans on tables of documents(doc_id, text) and queries(item_id, text).

ingest puts documents into a collection and appends its report there; ask reads one with --collection.  chunk and report read documents; search, ask, eval and ablation read queries too, eval and ablation with any of the columns
answerable, evidence, documents and ids that they have.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = ("ingest", "chunk", "search", "ask", "eval", "ablation", "report")


def _documents(docs: DataFrame) -> DataFrame:
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text"), F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("headings")))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), page.alias("pages"))


def _origin(docs: DataFrame) -> DataFrame:
    given = lambda c: F.col(c) if c in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), given("title").cast("string").alias("title"), given("authority").cast("string").alias("authority"), given("document_type").cast("string").alias("document_type"), (F.col("publication_date") if "publication_date" in docs.columns else F.lit(None)).cast("date").alias("publication_date"))


def _items(queries: DataFrame) -> DataFrame:
    kinds = {"answerable": F.lit(True), "evidence": F.array().cast("array<struct<document_id: string, pages: array<int>>>"), "documents": F.array().cast("array<string>"), "ids": F.array().cast("array<string>")}
    return queries.select(F.col("item_id").alias("query_id"), "text", *[(F.col(c) if c in queries.columns else none).alias(c) for c, none in kinds.items()])


def main(args: list[str] | None = None) -> None:
    from .operators import chunking, sparse, validation
    from .plans import evaluation, ingestion, retrieval
    from .plans.config import load, merge
    from .sources.stores import write_jsonl

    p = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--documents")
    p.add_argument("--collection", help="folder that ingest writes and ask may read")
    p.add_argument("--authority", nargs="*", help="an explicit filter of ask")
    p.add_argument("--traces", help="folder to which ask appends a trace of each question")
    p.add_argument("--queries")
    p.add_argument("--out")
    p.add_argument("--report", help="folder for the means and rows of an evaluation as JSON lines")
    p.add_argument("--config")
    p.add_argument("--strategy", choices=tuple(chunking.STRATEGIES))
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--steps", nargs="*", choices=tuple(evaluation.STEPS))
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if not a.documents and not (a.command == "ask" and a.collection):
        p.error(f"{a.command} needs --documents")
    docs = spark.read.parquet(a.documents) if a.documents else None
    settings = merge(load(a.config), {"chunking": {"strategy": a.strategy}} if a.strategy else {})
    if a.command in ("search", "ask", "eval", "ablation") and not a.queries:
        p.error(f"{a.command} needs --queries")
    queries = spark.read.parquet(a.queries) if a.queries else None
    corpus = evaluation.Corpus(_documents(docs), _origin(docs)) if docs is not None else None
    if a.command == "ingest":
        if not a.collection:
            p.error("ingest needs --collection")
        pages = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
        out = ingestion.ingest(pages, _origin(docs).join(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_order")), "document_id"), settings, ingestion.Collection(spark, a.collection))[1]
        ingestion.save_report(out, settings, a.collection)
    elif a.command == "chunk":
        c = settings["chunking"]
        out = chunking.chunk(_documents(docs), c["strategy"], chunking.Sizes(c["max_tokens"], c["overlap"], c["child_tokens"]))
    elif a.command == "search":
        index = sparse.build(docs, "doc_id", F.col("text"))
        out = sparse.search(index, queries.select(F.col("item_id").alias("query_id"), "text"), a.top_k)
    elif a.command == "ask":
        none = F.array().cast("array<string>")
        flt = F.struct(F.array(*map(F.lit, a.authority or ())).cast("array<string>").alias("authority"), none.alias("document_type"), none.alias("document_id"), F.lit(None).cast("date").alias("gte"), F.lit(None).cast("date").alias("lte"))
        asked = queries.select(F.col("item_id").alias("query_id"), "text", *([flt.alias("filter")] if a.authority else []))
        if a.collection:
            known = ingestion.Collection(spark, a.collection)
            search, chunks = known.retriever(settings), known.chunks()
        else:
            search, chunks = corpus.retriever(settings), corpus.chunks(settings["chunking"])
        out, rows = retrieval.respond(asked, search, chunks, settings)
        if a.traces:
            write_jsonl(rows, a.traces, append=True)
    elif a.command == "eval":
        rows = evaluation.evaluate(_items(queries), corpus, settings)
        if a.report:
            evaluation.report(rows, settings, "eval", a.report)
        out = rows if a.out else evaluation.summary(rows)
    elif a.command == "ablation":
        bare = [s for s, change in evaluation.STEPS.items() if not evaluation.needs_model(change)]  # there is no model here
        out = evaluation.ablation(_items(queries), corpus, settings, steps={s: evaluation.STEPS[s] for s in a.steps or bare})
    else:
        pages = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_order"), F.lit(1).alias("page_number"), "text")
        out = validation.ingest(pages)[1]
    out.write.mode("overwrite").parquet(a.out) if a.out else out.show(50, truncate=80)


if __name__ == "__main__":
    main()
