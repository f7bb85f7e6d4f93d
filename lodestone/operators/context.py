"""Evidence contexts under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from ..functions.text import strip, token_count
from ..sources.tables import written
from .fusion import deduplicate

SIMILARITY = 0.9  # of the deduplication that every context gets

# The prompt registry.
PROMPTS = {
    "v1": "Answer only from the evidence. Cite chunk ids. If the evidence is not sufficient, say so. Reply as JSON with answer, citations and insufficient_evidence.",
}


def pages_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p."), start.cast("string"))).otherwise(F.concat(F.lit("pp."), start.cast("string"), F.lit("-"), end.cast("string")))


def header(id_: str = "id") -> Column:
    """First line of an evidence block, from the columns of a hit."""
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(" | §"), F.col("section"))).otherwise("")
    date = F.coalesce(F.col("publication_date").cast("string"), F.lit("None"))
    return F.concat(F.lit("[chunk_id: "), F.col(id_), F.lit("] "), "authority", F.lit(" — "), "title", section, F.lit(" | "), pages_label(F.col("page_start"), F.col("page_end")), F.lit(" | "), date)


def expand(hits: DataFrame, chunks: DataFrame | None = None, window: int = 1) -> DataFrame:
    """hits with their parent's text, or else, where chunks are given, with the text and pages of their neighbours."""
    out = hits.withColumn("text", F.when(F.coalesce("parent_text", F.lit("")) != "", F.col("parent_text")).otherwise(F.col("text")))
    if chunks is None:
        return out
    from .chunking import neighbours

    near = written(neighbours(chunks, hits.where("coalesce(parent_text, '') = ''").select(F.col("id").alias("chunk_id")), window), "neighbours")
    own = chunks.select(F.col("chunk_id").alias("neighbour_id"), F.col("text").alias("t"), F.col("page_start").alias("s"), F.col("page_end").alias("e"))
    wide = broadcast_if_small(near).join(own, "neighbour_id").groupBy(F.col("chunk_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "t"))), lambda x: x["t"]), "\n").alias("_t"), F.min("s").alias("_s"), F.max("e").alias("_e")
    )
    replaced = {c: F.coalesce(n, c) for c, n in (("text", "_t"), ("page_start", "_s"), ("page_end", "_e"))}
    return out.join(wide, "id", "left").withColumns(replaced).drop("_t", "_s", "_e")


def build(hits: DataFrame, budget: int = 6000, per_document: int = 4, chunks: DataFrame | None = None, window: int = 1) -> DataFrame:
    """(query_id, ids, context, token_count, dropped) of each query.

    In rank order a hit is left out if its document has its share, if its parent is in already, or if its
    block doesn't fit what is left of the budget; a later smaller one may still fit, so this is a fold
    over each query's few hits and not a running sum.
    hits: query_id, rank, id, text, document_id, page_start, page_end, section, title, authority,
    publication_date, parent_id, parent_text.
    """
    wide = expand(deduplicate(hits, SIMILARITY), chunks, window)
    block = F.concat(header(), F.lit("\n"), strip(F.col("text")))
    rows = wide.withColumn("block", block).withColumn("tokens", token_count(F.col("block")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "document_id", "parent_id", "block", "tokens"))).alias("items"))
    start = F.struct(F.slice("items", 1, 0).alias("taken"), F.lit(0).alias("used"), F.lit(0).alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        share = F.size(F.filter(acc["taken"], lambda t: t["document_id"] == x["document_id"])) >= per_document
        sibling = F.exists(acc["taken"], lambda t: (x["parent_id"] != "") & (t["parent_id"] == x["parent_id"]))
        skip = share | F.coalesce(sibling, F.lit(False))
        fits = acc["used"] + x["tokens"] <= budget
        taken = F.struct(F.concat(acc["taken"], F.array(x)).alias("taken"), (acc["used"] + x["tokens"]).alias("used"), acc["dropped"].alias("dropped"))
        over = F.struct(acc["taken"].alias("taken"), acc["used"].alias("used"), (acc["dropped"] + 1).alias("dropped"))
        return F.when(skip, acc).when(fits, taken).otherwise(over)

    out = lists.select("query_id", F.aggregate("items", start, step).alias("r"))
    return out.select(
        "query_id", F.transform("r.taken", lambda t: t["id"]).alias("ids"), F.array_join(F.transform("r.taken", lambda t: t["block"]), "\n\n").alias("context"),
        F.col("r.used").alias("token_count"), F.col("r.dropped").alias("dropped"),
    )


def prompts(rows: DataFrame, version: str = "v1") -> DataFrame:
    """rows(context, question, ...) with system and user, as providers.generate() takes them; an unknown version is an error."""
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version}")
    return rows.withColumns({"system": F.lit(PROMPTS[version]), "user": F.concat(F.lit("EVIDENCE:\n"), "context", F.lit("\n\nQUESTION: "), "question")})
