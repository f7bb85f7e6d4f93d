"""Evidence review: the best passages of the pages that an evaluation item names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, sparse_tokens, squash
from .intervals import overlapping
from .sparse import EPSILON


def local_bm25(candidates: DataFrame, keys: list[str], k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """candidates(*keys, id, text, query) with score and rank: BM25 whose statistics are those of each group alone."""
    one = candidates.select(*keys, "id", sparse_tokens(F.col("text")).alias("toks"), sparse_tokens(F.col("query")).alias("q"))
    size = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("mean"))
    tf = one.select(*keys, "id", F.size("toks").alias("dl"), "q", F.explode("toks").alias("term")).groupBy(*keys, "id", "dl", "q", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df")).join(size, keys).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.groupBy(*keys).agg((EPSILON * F.avg("raw")).alias("floor"))
    idf = df.join(floor, keys).select(*keys, "term", "mean", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    qtf = F.size(F.filter("q", lambda x: x == F.col("term")))
    part = qtf * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scores = tf.join(idf, [*keys, "term"]).groupBy(*keys, "id").agg(F.round(F.sum(part), digits).alias("score"))
    every = one.select(*keys, "id").join(scores, [*keys, "id"], "left").fillna(0.0, ["score"])
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_window(text: Column, query: Column, size: int = 600, step: int = 100) -> Column:
    """The window of a squashed text that shares most query terms, the first of equals, with a mark if it isn't the beginning."""
    def best(t: Column, q: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(t) - size + step - 1, F.lit(0)), F.lit(step))
        shared = lambda s: F.size(F.array_intersect(q, sparse_tokens(F.substr(t, s + 1, F.lit(size)))))
        top = F.array_max(F.transform(starts, lambda s: F.struct(shared(s).alias("n"), (-s).alias("at"))))
        cut = let(-top["at"], lambda at: F.concat(F.when(at > 0, "…").otherwise(""), F.substr(t, at + 1, F.lit(size))))
        return F.when(F.length(t) <= size, t).otherwise(cut)

    return let(squash(text), lambda t: let(F.array_distinct(sparse_tokens(query)), lambda q: best(t, q)))


def review(items: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, document_id, rank, id, score, excerpt) of the k best chunks on each piece of evidence's pages.

    items: query_id, question, evidence (array of document_id, pages).
    """
    ev = items.select("query_id", "question", F.explode("evidence").alias("e")).select("query_id", "question", "e.document_id", F.array_min("e.pages").alias("lo"), F.array_max("e.pages").alias("hi"))
    near = overlapping(ev, chunks, ["document_id"], ("lo", "hi"), ("page_start", "page_end"))
    text = F.concat(F.coalesce("section", F.lit("")), F.lit(" "), "text")
    ranked = local_bm25(near.select("query_id", "document_id", "lo", F.col("chunk_id").alias("id"), text.alias("text"), F.col("question").alias("query")), ["query_id", "document_id", "lo"], k)
    shown = ranked.join(near.select("query_id", "document_id", "lo", F.col("chunk_id").alias("id"), "text", "question"), ["query_id", "document_id", "lo", "id"])
    return shown.select("query_id", "document_id", "rank", "id", "score", best_window(F.col("text"), F.col("question")).alias("excerpt"))
