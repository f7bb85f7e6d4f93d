"""Cleaning of page texts: running heads, page numbers, broken words and wrapped lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLOCK_START, LINE_BREAK, PAGE_NUMBER, let, line_key, strip


def repeated_lines(pages: DataFrame, min_ratio: float = 0.5, edge: int = 3) -> DataFrame:
    """(document_id, line, n): keys of first and last lines that enough pages of a document share."""
    full = F.filter(F.split("text", LINE_BREAK), lambda x: strip(x) != "")
    some = F.greatest(F.lit(1), F.least(F.lit(edge), F.floor(F.size("full") / 4).cast("int")))
    edges = F.array_distinct(F.transform(F.concat(F.slice("full", 1, F.col("k")), F.slice("full", -F.col("k"), F.col("k"))), line_key))
    keyed = pages.withColumn("full", full).withColumn("k", F.least(some, F.greatest(F.size("full"), F.lit(1)))).select("document_id", F.explode(F.when(F.size("full") > 0, edges).otherwise(F.array().cast("array<string>"))).alias("line"))
    counts = keyed.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    enough = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * min_ratio))
    return counts.join(sizes, "document_id").where(enough & (F.col("line") != "")).select("document_id", "line", "n")


def remove_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """pages without their documents' repeated lines, wherever these stand, and without page numbers."""
    heads = repeated.groupBy("document_id").agg(F.collect_set("line").alias("_heads"))
    keep = lambda x: ~F.coalesce(F.array_contains("_heads", line_key(x)), F.lit(False)) & ~x.rlike(PAGE_NUMBER)
    return pages.join(heads, "document_id", "left").withColumn("text", F.array_join(F.filter(F.split("text", LINE_BREAK), keep), "\n")).drop("_heads")


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def unwrap(text: Column) -> Column:
    """Soft line breaks become spaces: a line joins the one before unless either is blank, it starts a block, or that one ends a clause.

    What a line joins ends like the raw line before it, so each joint needs only two neighbours.
    """

    def joined(lines: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            before = F.element_at(lines, F.greatest(i, F.lit(1)))  # element_at counts from 1: the line before line i
            soft = (x != "") & (before != "") & ~x.rlike(BLOCK_START) & ~before.rlike("[.:;]$")
            return F.concat(F.when(i == 0, "").when(soft, " ").otherwise("\n"), x)

        return F.array_join(F.transform(lines, part), "")

    return let(F.transform(F.split(text, "\n"), strip), joined)


def clean(text: Column) -> Column:
    """All of the above but running heads, then single spaces and at most one blank line."""
    out = unwrap(join_hyphens(F.replace(text, F.lit("\r"), F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(out, "[ \t ]+", " "), r"\n{3,}", "\n\n")
    return strip(out)
