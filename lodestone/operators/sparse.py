"""BM25 for any number of queries at once, over a table of tokenised documents.  Ids may be of any type that sorts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small, spread
from ..functions.text import sparse_tokens
from ..sources.tables import written
from .ranking import DIGITS, META, Best, Filters, hit_schema, top_k

EPSILON = 0.25  # of the mean idf, in place of a negative one
MOST_WEIGHTS = 1_000_000  # (query, term) pairs that are broadcast: 24 MB and the terms; more queries go by joins
BATCH = 2048  # documents that are scored at once
CELLS = 1 << 22  # scores of a batch
PRODUCTS = 1 << 19  # that are added up at once: some 30 MB of arrays


@dataclass
class Index:
    terms: DataFrame  # term, df, idf
    tokens: DataFrame  # id, toks, dl
    size: int
    mean_length: float
    k1: float
    b: float


def build(docs: DataFrame, id_: str, text: Column, k1: float = 1.5, b: float = 0.75, meta: bool = False) -> Index:
    """Statistics over all documents, empty ones included.  Texts are tokenised once, into a table that all else reads.

    meta keeps the columns authority, document_type, document_id and publication_date, which filters of queries judge.
    """
    own = META if meta else []
    toks = spread(docs.select(F.col(id_).alias("id"), text.alias("text"), *own)).select("id", sparse_tokens(F.col("text")).alias("toks"), *own).withColumn("dl", F.size("toks"))
    toks = written(toks, "terms")
    n, mean = toks.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = written(df, "frequencies")
    return _index(df, toks, n, mean or 0.0, k1, b)


def _index(df: DataFrame, toks: DataFrame, n: int, mean: float, k1: float, b: float) -> Index:
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    return Index(raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")), toks, n, mean, k1, b)


def save(index: Index, path: str) -> None:
    """Write an index once; load() gives it to any session."""
    index.tokens.write.parquet(f"{path}/tokens")
    index.terms.select("term", "df").write.parquet(f"{path}/frequencies")
    spark = index.tokens.sparkSession
    spark.createDataFrame([(index.size, index.mean_length, index.k1, index.b)], "size long, mean_length double, k1 double, b double").write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Index:
    own = spark.read.parquet(f"{path}/settings").first()
    return _index(spark.read.parquet(f"{path}/frequencies"), spark.read.parquet(f"{path}/tokens"), *own)


def weights(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, w): idf times multiplicity of the terms of queries(query_id, text)."""
    asked = queries.select("query_id", F.explode(sparse_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return index.terms.join(broadcast_if_small(asked), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of every pair with a score above 0, by joins of query terms and postings."""
    asked = weights(index, queries)
    wanted = broadcast_if_small(asked.select("term").distinct())
    hits = index.tokens.select("id", "dl", F.explode("toks").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    norm = F.col("tf") + index.k1 * (1 - index.b + index.b * F.col("dl") / F.lit(index.mean_length or 1.0))
    part = F.col("w") * F.col("tf") * (index.k1 + 1) / norm
    return hits.join(broadcast_if_small(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) of queries(query_id, text[, filter]): one scan of the token table for all queries.

    With a column filter in queries, a struct as passes() takes it, only documents whose metadata pass it are ranked; their
    scores are those without a filter.  Without one a null filter passes all.

    The queries' weights are broadcast as the rows of a sparse matrix; a batch of documents is multiplied with it, and a task
    sends its own k best of each query, so no postings are shuffled.  More than MOST_WEIGHTS weights are joined.
    """
    filtered = "filter" in queries.columns
    asked = weights(index, queries).limit(MOST_WEIGHTS + 1).toArrow()
    if asked.num_rows > MOST_WEIGHTS:
        found = scores(index, queries)
        if filtered:
            meta = index.tokens.select("id", F.struct(*META).alias("_m"))
            found = found.join(meta, "id").join(queries.select("query_id", F.col("filter").alias("_f")), "query_id").where(passes("_f", "_m"))
        return top_k(found, k).select("query_id", "rank", "id", "score")
    rows = index.tokens.where("id IS NOT NULL") if filtered else index.tokens.where("id IS NOT NULL").select("id", "toks", "dl")
    known = _Weights(asked)
    if filtered:
        weighted = weights(index, queries).select("query_id").distinct()  # no more queries than weights
        known.restrict(queries.select("query_id", "filter").where("filter IS NOT NULL").join(weighted, "query_id", "left_semi").collect())
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = hit_schema(queries.schema["query_id"].dataType, rows.schema["id"].dataType)
    found = rows.mapInArrow(_scorer(shared, k, index.k1, index.b, index.mean_length or 1.0), schema)
    return top_k(found, k).select("query_id", "rank", "id", "score")


class _Weights:
    """Sparse rows of terms: which queries have the term, with which weight."""

    def __init__(self, asked: pa.Table):
        terms, names = (asked[c].combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        terms, names = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (terms, names))
        term = np.asarray(terms.indices, np.int64)
        order = np.argsort(term, kind="stable")
        self.terms, self.names = terms.dictionary, names.dictionary
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.query = np.asarray(names.indices, np.int64)[order]
        self.weight = asked["w"].to_numpy()[order]
        self.filters: Filters | None = None

    def restrict(self, rows: list) -> None:
        """Filters of the queries, by (query_id, filter); a query without one passes all."""
        of = {r["query_id"]: r["filter"] for r in rows}
        if any(f is not None for f in of.values()) and len(self.names):
            self.filters = Filters([of.get(n) for n in self.names.to_pylist()])

    def times(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Products of n sparse document rows with all queries."""
        width = len(self.names)
        out = np.zeros(n * width)
        size = self.first[term + 1] - self.first[term]
        past = np.cumsum(size)
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(past, (past[i - 1] if i else 0) + PRODUCTS)))
            s = size[i:j]
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.first[term[i:j]], s)
            out += np.bincount(np.repeat(doc[i:j] * width, s) + self.query[at], weights=np.repeat(value[i:j], s) * self.weight[at], minlength=len(out))
            i = j
        return out.reshape(n, width)


def _scorer(shared, k: int, k1: float, b: float, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        best = Best(w.names, k)
        many = max(1, len(w.terms))
        rows = min(BATCH, max(1, CELLS // max(1, len(w.names))))
        for whole in batches:
            for i in range(0, len(whole), rows):
                batch = whole.slice(i, rows)
                n = len(batch)
                toks = batch.column("toks")
                term = pa.compute.index_in(toks.flatten(), w.terms)
                doc = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(toks).fill_null(0)))
                has = np.asarray(term.is_valid())
                cell, tf = np.unique(doc[has] * many + np.asarray(term.drop_null()).astype(np.int64), return_counts=True)
                doc, term = cell // many, cell % many
                norm = k1 * (1 - b + b * np.asarray(batch.column("dl"), np.float64) / mean)
                score = np.round(w.times(doc, term, tf * (k1 + 1) / (tf + norm[doc]), n), DIGITS)
                score[score <= 0] = -np.inf
                if w.filters:
                    score[~w.filters.passes(batch)] = -np.inf
                best.add(score, batch.column("id"))
        yield from best.batches()

    return run


def passes(filters: str, meta: str) -> Column:
    """Metadata predicate: lists and a date range must all hold; empty lists don't restrict and a null date passes.

    filters and meta are aliases: filters has authority, document_type, document_id (arrays), gte and lte (dates).
    """
    ok = F.lit(True)
    for c in ("authority", "document_type", "document_id"):
        wanted = F.col(f"{filters}.{c}")
        ok &= F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.array_contains(wanted, F.col(f"{meta}.{c}")), F.lit(False))
    date = F.col(f"{meta}.publication_date")
    ok &= F.coalesce(date >= F.col(f"{filters}.gte"), F.lit(True))
    return ok & F.coalesce(date <= F.col(f"{filters}.lte"), F.lit(True))
