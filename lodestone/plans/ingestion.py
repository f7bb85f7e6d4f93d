"""From pages to a collection: cleaning, validation, chunks, vectors and postings, with a report; and searches over what was ingested."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_text
from ..operators import chunking, cleaning, dense, providers, sparse, validation
from ..operators.postings import Postings
from ..operators.ranking import META
from ..sources import documents as src
from ..sources.stores import VectorTable
from ..sources.tables import written
from . import retrieval

_PAGE = "array<struct<page_number: int, text: string, section: string, headings: array<string>>>"
#: Attributes of a document that its chunks carry.
ORIGIN = {"title": "string", "authority": "string", "document_type": "string", "publication_date": "date", "source_url": "string"}


class Collection:
    """What was ingested below a path: chunks, vectors by point id, and postings."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embed = embed or providers.embedder("hashing")
        self.vectors, self.postings = VectorTable(spark, f"{self.path}/vectors"), Postings(spark, f"{self.path}/postings")

    def add(self, chunks: DataFrame, contextual: bool = False) -> None:
        """Chunks of new documents, or new chunks in the place of those with their ids."""
        headed = index_text(F.col("text"), F.col("section"), F.coalesce("title", F.lit("")), F.coalesce("authority", F.lit("")))
        text, embedded = (headed, headed) if contextual else (index_text(F.col("text"), F.col("section")), F.col("text"))
        made = self.embed(chunks, "chunk_id", embedded, False).withColumnRenamed("id", "chunk_id")
        self.vectors.upsert(chunks.join(made, "chunk_id"))
        self.postings.add(chunks, "chunk_id", text)

    def chunks(self) -> DataFrame:
        return self.vectors.scan().drop("point_id", "vector").withColumn("id", F.col("chunk_id"))

    def retriever(self, settings: dict[str, Any]) -> retrieval.Retriever:
        """dense, bm25 or hybrid search; filters are judged inside both."""
        r = settings["retrieval"]

        def by_terms(queries: DataFrame, k: int) -> DataFrame:
            if "filter" not in queries.columns:
                return self.postings.search(queries, k)
            index = self.postings.index()
            return sparse.search(replace(index, tokens=index.tokens.join(self.chunks().select("id", *META), "id")), queries, k)

        def by_vector(queries: DataFrame, k: int) -> DataFrame:
            asked = self.embed(queries, "query_id", F.col("text"), True).withColumnRenamed("id", "query_id")
            if "filter" in queries.columns:
                asked = asked.join(queries.select("query_id", "filter"), "query_id")
            return dense.search(self.vectors.scan().withColumn("id", F.col("chunk_id")), asked, k)

        if r["type"] == "hybrid":
            return retrieval.hybrid(by_vector, by_terms, r["dense_top_k"], r["sparse_top_k"], r["rrf_k"], (r["dense_weight"], r["sparse_weight"]))
        return {"dense": by_vector, "bm25": by_terms}[r["type"]]


def ingest(pages: DataFrame, origin: DataFrame, settings: dict[str, Any], collection: Collection | None, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, one-row report) of pages(document_id, page_number, text[, headings]); with a collection, the chunks are added to it.

    origin: document_id, doc_order, and what there is of ORIGIN; of documents with the same text the first by doc_order stays.  failed:
    document_id, error of those that couldn't be read, which the others don't wait for.
    """
    c, i = settings["chunking"], settings["ingestion"]
    heads = F.col("headings") if "headings" in pages.columns else F.array().cast("array<string>")
    rows = cleaning.remove_lines(pages, cleaning.repeated_lines(pages, i["header_footer_min_ratio"]))
    one = F.struct(F.col("page_number").cast("int").alias("page_number"), cleaning.clean(F.col("text")).alias("text"), F.lit(None).cast("string").alias("section"), heads.alias("headings"))
    whole = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).cast(_PAGE).alias("pages"))
    flat = chunking.carry_sections(whole).select("document_id", F.explode("pages").alias("page")).join(origin.select("document_id", "doc_order"), "document_id")
    flat = written(flat.select("document_id", "doc_order", F.col("page.page_number").alias("page_number"), F.col("page.text").alias("text"), "page"), "pages")
    checked, report = validation.ingest(flat, i["min_page_chars"])
    kept = checked.where("status = 'kept'").groupBy("document_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    given = origin.select("document_id", *[(F.col(n) if n in origin.columns else F.lit(None)).cast(kind).alias(n) for n, kind in ORIGIN.items()])
    sizes = chunking.Sizes(c["max_tokens"], c["overlap"], c["child_tokens"])
    chunks = written(chunking.chunk(kept, c["strategy"], sizes).join(given, "document_id"), "chunks")
    if collection:
        collection.add(chunks, c["contextual_header"])
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks_generated"), F.count_distinct("document_id").alias("documents_processed"))
    bad = failed.select("document_id").distinct().agg(F.count(F.lit(1)).alias("documents_failed")) if failed is not None else counts.select(F.lit(0).cast("long").alias("documents_failed"))
    key = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  one row each
    return chunks, key(report).join(key(counts), "_one").join(key(bad), "_one").drop("_one")


def ingest_spans(spans: DataFrame, origin: DataFrame, settings: dict[str, Any], collection: Collection | None) -> tuple[DataFrame, DataFrame]:
    """ingest() of the span rows of files, as sources.documents.read_spans() gives them; a file with an error is counted as failed."""
    kept = written(spans, "spans")
    failed = kept.where("error IS NOT NULL").select("document_id", "error")
    good = kept.where("error IS NULL").join(failed.select("document_id"), "document_id", "left_anti")
    return ingest(src.page_lines(good), origin, settings, collection, failed)


def save_report(report: DataFrame, settings: dict[str, Any], path: str) -> None:
    report.withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).write.mode("append").json(f"{path}/reports")
