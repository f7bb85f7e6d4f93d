"""Quality checks of ingested pages and documents, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_hash

MIN_PAGE_CHARS = 80


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with first: the order struct of the first row of its key.  Partial minima, so a frequent key is no hot group."""
    least = df.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return df.join(least, key)


def duplicate_documents(pages: DataFrame) -> DataFrame:
    """(document_id, doc_order, same_as): same_as is the earliest document of equal normalised text, or null.

    pages: document_id, doc_order, page_number, text.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), " ")
    docs = pages.groupBy("document_id", "doc_order").agg(text_hash(joined).alias("hash"))
    found = first_of_each(docs, "hash", ["doc_order", "document_id"])
    return found.select("document_id", "doc_order", F.when(F.col("first.document_id") != F.col("document_id"), F.col("first.document_id")).alias("same_as"))


def check_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """pages with status: kept, near_empty, or duplicate of an earlier page anywhere.  Near-empty pages are nobody's original."""
    rows = pages.withColumn("_short", F.length("text") < min_chars).withColumn("_hash", text_hash(F.col("text")))
    full = rows.where("NOT _short")
    least = full.groupBy("_hash").agg(F.min(F.struct("doc_order", "page_number")).alias("_first"))
    status = F.when(F.col("_short"), "near_empty").when(F.col("_first") == F.struct("doc_order", "page_number"), "kept").otherwise("duplicate")
    return rows.join(least, "_hash", "left").withColumn("status", status).drop("_short", "_hash", "_first")


def ingest(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(checked pages of documents that aren't duplicates, one-row report)."""
    docs = duplicate_documents(pages)
    unique = docs.where("same_as IS NULL").select("document_id")
    checked = check_pages(pages.join(unique, "document_id", "left_semi"), min_chars)
    count = lambda s: F.count_if(F.col("status") == s)
    of_pages = checked.agg(
        F.count(F.lit(1)).alias("pages_processed"), count("near_empty").alias("near_empty_pages"), F.count_if(F.col("text") == "").alias("failed_pages"),
        count("duplicate").alias("duplicate_pages_removed"), count("kept").alias("pages_kept"),
    )
    kept = checked.where("status = 'kept'").select("document_id").distinct()
    empty = unique.join(kept, "document_id", "left_anti").agg(F.count(F.lit(1)).alias("empty_documents"))
    of_docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count("same_as").alias("duplicate_documents"))
    # one row each
    one = lambda df: df.withColumn("_one", F.lit(1))
    return checked, one(of_docs).join(one(of_pages), "_one").join(one(empty), "_one").drop("_one")


def summary(report: DataFrame) -> str:
    r = report.first()
    return "\n".join(f"{name.replace('_', ' ').capitalize()}: {r[name]:,}" for name in report.columns)
