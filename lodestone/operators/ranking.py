"""The best rows of each query: a few of every task, then of all."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS = ("authority", "document_type", "document_id")
META = [*LISTS, "publication_date"]  # columns that filters judge
DIGITS = 6  # scores are rounded, so that equal sums in another order stay ties


def top_k(scored: DataFrame, k: int, score: str = "score", id_: str = "id") -> DataFrame:
    """(query_id, rank, ...): the k best of each query, ties by id.  Only k rows a query and task are shuffled."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(id_))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_schema(query_id: T.DataType, id_: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_id), T.StructField("id", id_), T.StructField("score", T.DoubleType())])


class Best:
    """The k best ids of each of some queries among the rows that one task sees; ids of any type that sorts."""

    def __init__(self, names: pa.Array, k: int):
        self.names, self.k = names, k
        self.least = np.full(len(names), -np.inf)  # of queries that have k ids: the lowest score among them
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        """Scores of some rows, a column for each query; -inf is no hit."""
        n = len(score)
        if not n or not len(self.names):
            return
        cut = np.partition(score, n - self.k, axis=0)[n - self.k] if n > self.k else np.full(len(self.names), -np.inf)
        row, query = np.nonzero((score >= np.maximum(cut, self.least)) & (score > -np.inf))
        self.held.append(pa.table({"query": query, "score": score[row, query], "id": ids.take(pa.array(row))}))
        self.rows += len(row)
        if self.rows > 2 * self.k * len(self.names) + 65536:
            self._prune()

    def _prune(self) -> pa.Table:
        table = pa.concat_tables(self.held).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = table["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        table = table.filter(pa.array(place < self.k))
        full = place == self.k - 1
        self.least[query[full]] = table["score"].to_numpy()[place[place < self.k] == self.k - 1]
        self.held, self.rows = [table], len(table)
        return table

    def batches(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        table = self._prune()
        out = pa.table({"query_id": self.names.take(table["query"].combine_chunks()), "id": table["id"], "score": table["score"]})
        return out.to_batches()


class Filters:
    """Distinct filters of some queries, as masks over the rows of a batch.  A row is judged before it is ranked."""

    def __init__(self, filters: list, null_dates: bool = True):
        self.null_dates = null_dates
        keys = [tuple((tuple(f[c] or ()) if c in LISTS else f[c]) for c in (*LISTS, "gte", "lte")) if f else ((), (), (), None, None) for f in filters]
        place = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        self.distinct = list(place)
        self.of_query = np.array([place[x] for x in keys])

    def passes(self, batch: pa.RecordBatch) -> np.ndarray:
        """(row, query): which rows each query may find."""
        return np.stack([self._mask(batch, *f) for f in self.distinct], axis=1)[:, self.of_query]

    def _mask(self, batch: pa.RecordBatch, *f) -> np.ndarray:
        ok = np.ones(len(batch), bool)
        for c, wanted in zip(LISTS, f):
            if wanted:
                ok &= np.asarray(pa.compute.is_in(batch.column(c), value_set=pa.array(wanted, pa.string())))
        dates = batch.column("publication_date")
        for bound, compare in ((f[3], pa.compute.greater_equal), (f[4], pa.compute.less_equal)):
            if isinstance(bound, datetime.date):
                ok &= np.asarray(compare(dates, pa.scalar(bound, pa.date32())).fill_null(self.null_dates))
        return ok
