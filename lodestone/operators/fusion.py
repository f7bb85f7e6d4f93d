"""Rank fusion, interleaving, boosting, near-duplicate removal and lexical reranking of ranked lists.

Ranked lists are rows (query_id, list_no, rank, id, ...): list_no orders the lists of a query, rank starts
at 1.  A query has a bounded number of hits, so windows over a query's hits are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, shingles, sparse_tokens

RRF_K = 60
WITHIN_PAGES = 0.5  # similarity from which a chunk inside a kept chunk's pages is a duplicate


def dealt(lists: DataFrame, *keys: str) -> DataFrame:
    """Rows of several lists with all of a query's rows of one key in one partition, dealt anew.

    Lists that are ranked already are partitioned by query each, and a union of them is taken to be so as a whole; but
    adaptive execution coalesces the partitions of each list on its own, after which an aggregate over the union sees a
    query in parts.  Dealing by the query alone would be taken for done.
    """
    return lists.repartition("query_id", *keys)


def rrf(lists: DataFrame, k: int, rrf_k: int = RRF_K, weights: dict[int, float] | None = None, digits: int = 9) -> DataFrame:
    """(query_id, rank, id, score, sources): sum of weight / (rrf_k + rank); ties keep the order of first sight."""
    weight: Column = F.lit(1.0)
    for no, w in (weights or {}).items():
        weight = F.when(F.col("list_no") == no, F.lit(float(w))).otherwise(weight)
    fused = dealt(lists, "id").groupBy("query_id", "id").agg(
        F.round(F.sum(weight / (F.lit(rrf_k) + F.col("rank"))), digits).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
        F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("sources"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "sources")


def interleave(lists: DataFrame, k: int, keep: list[str] | None = None) -> DataFrame:
    """(query_id, rank, id, the columns keep) of two lists in turn, the one of smaller list_no first; an id counts where it comes first.

    k of 0 takes all.
    """
    others = [F.col(c) for c in keep or []]
    slot = dealt(lists, "id").groupBy("query_id", "id").agg(F.min(F.struct("rank", "list_no", *others)).alias("slot"))
    w = Window.partitionBy("query_id").orderBy("slot.rank", "slot.list_no")
    out = slot.withColumn("rank", F.row_number().over(w))
    return (out.where(F.col("rank") <= k) if k else out).select("query_id", "rank", "id", *[f"slot.{c}" for c in keep or []])


def boost(hits: DataFrame, matches: Column, ranks: int = 5) -> DataFrame:
    """hits with matching rows moved up by so many places; others keep their order."""
    place = F.when(matches, F.col("rank") - ranks).otherwise(F.col("rank"))
    w = Window.partitionBy("query_id").orderBy(place, "rank")
    return hits.withColumn("_new", F.row_number().over(w)).drop("rank").withColumnRenamed("_new", "rank")


def overlap_rerank(hits: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """hits(query_id, rank, id, text or toks) by the share of the query's distinct terms that the text has.  toks: the terms of an index, which
    then aren't looked for again in the text."""
    q = queries.select("query_id", F.array_distinct(sparse_tokens(F.col("text"))).alias("_q"))
    own = F.col("toks") if "toks" in hits.columns else sparse_tokens(F.col("text"))
    share = F.size(F.array_intersect("_q", own)) / F.greatest(F.size("_q"), F.lit(1))
    scored = hits.join(q, "query_id").withColumn("score", F.round(share, digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("_new", F.row_number().over(w)).where(F.col("_new") <= k).drop("rank", "_q").withColumnRenamed("_new", "rank")


def pair_similarity(hits: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, rank_a, rank_b, similarity) of all pairs of a query's hits (query_id, rank, text)."""
    s = hits.select("query_id", "rank", shingles(F.col("text")).alias("s"))
    a, b = s.select("query_id", F.col("rank").alias("rank_a"), F.col("s").alias("sa")), s.select("query_id", F.col("rank").alias("rank_b"), F.col("s").alias("sb"))
    return a.join(b, "query_id").where("rank_a < rank_b").select("query_id", "rank_a", "rank_b", F.round(jaccard(F.col("sa"), F.col("sb")), digits).alias("similarity"))


def deduplicate(hits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """hits(query_id, rank, id, text, document_id, page_start, page_end) without repeats of a higher kept hit.

    A hit repeats a kept one of the same id; of the same document, inside its pages, from WITHIN_PAGES
    similarity on; or of any document from threshold on (1.0 turns that off).  A removed hit removes
    nothing itself, so the kept ones are a fold over each query's short list.
    """
    one = hits.withColumn("_s", shingles(F.col("text")))
    item = F.struct("rank", "id", "document_id", "page_start", "page_end", F.col("_s").alias("s"))
    lists = one.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def repeats(kept: Column, x: Column) -> Column:
        sim = lambda k: jaccard(k["s"], x["s"])
        inside = lambda k: (k["document_id"] == x["document_id"]) & (x["page_start"] >= k["page_start"]) & (x["page_end"] <= k["page_end"])
        return F.exists(kept, lambda k: (k["id"] == x["id"]) | (inside(k) & (sim(k) >= WITHIN_PAGES)) | ((F.lit(threshold) < 1.0) & (sim(k) >= threshold)))

    empty = F.slice(F.col("items"), 1, 0)
    kept = F.aggregate("items", empty, lambda acc, x: F.when(repeats(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    ranks = lists.select("query_id", F.posexplode(F.transform(kept, lambda k: k["rank"])).alias("_pos", "rank"))
    return hits.join(ranks, ["query_id", "rank"]).withColumn("rank", F.col("_pos") + 1).drop("_pos")
