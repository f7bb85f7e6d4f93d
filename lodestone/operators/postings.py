"""An inverted index for BM25, by term and in versions: a search reads the postings of its terms only.

Documents are dealt into runs.  A block holds the postings of one term in one run, with the most occurrences and the least
length among them, which bound what the term can add to the score of any document of the run.  Blocks lie in folders by a hash of their
term.  A search adds the bounds of its terms up, from the narrow columns of their blocks, scores the most promising runs of each query,
and then only those other runs whose bound isn't below the worst score that the query has by then.

Batches are added and removed without reading old texts: the numbers of documents and tokens stand in the manifest, the documents of
each term in a table, and both are sums over batches.  Removed documents are positions in their runs, which scoring leaves out.

Results equal sparse.search() over the same documents.  That one scans all tokens once for any number of queries; this one is for
queries whose terms are a small part of the vocabulary.  Ids may be of any type that sorts; rows without an id are not found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.sized import broadcast_if_small
from ..functions.text import sparse_tokens
from ..sources.snapshots import Snapshots
from ..sources.tables import written
from .ranking import DIGITS, Best, top_k
from .sparse import BATCH, CELLS, Index, _index, _Weights, weights

BUCKETS = 64  # folders that terms are dealt into
RUN_DOCUMENTS, RUN_TOKENS = 1 << 14, 1 << 22  # of a run at most; a longer document is a run of its own
FIRST_RUNS = 2  # of each query that are scored to get a score that others must reach


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Postings:
    """The index at a path; every call sees the version that is current then."""

    def __init__(self, spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75, run_documents: int = RUN_DOCUMENTS):
        self.spark, self.k1, self.b, self.run_documents = spark, k1, b, run_documents
        self.versions = Snapshots(spark, path)
        self._opened: tuple[int, Index] | None = None

    # ---- writing

    def add(self, docs: DataFrame, id_: str, text: Column) -> int:
        """A version with these documents too; those whose ids are there already take the place of the old ones."""
        name = self.versions.new_name()
        at = self.versions.batch(name)
        toks = docs.select(F.col(id_).alias("id"), sparse_tokens(text).alias("toks")).withColumn("dl", F.size("toks"))
        numbered = T.StructType([toks.schema["id"], toks.schema["toks"], toks.schema["dl"], T.StructField("run", T.StringType()), T.StructField("place", T.IntegerType())])
        toks.mapInArrow(_runs(name, self.run_documents), numbered).write.parquet(f"{at}/documents")
        made = self.spark.read.parquet(f"{at}/documents")
        blocks = made.mapInArrow(_blocks, "term string, run string, places array<int>, tfs array<int>, dls array<int>, most int, least int").withColumn("bucket", bucket_of(F.col("term")))
        blocks.repartitionByRange("bucket", "term", "run").sortWithinPartitions("bucket", "term", "run").write.partitionBy("bucket").parquet(f"{at}/postings")
        made.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{at}/frequencies")
        n, texts, length = made.agg(F.count(F.lit(1)), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        version, entries = self.versions.entries()
        before = [self._gone(entries, made.select("id"))] if entries else []
        entry = {"name": name, "kind": "rows", "n": n, "texts": texts, "length": length, "buckets": _children(self.versions, f"{at}/postings")}
        return self.versions.commit(lambda old: [*old, *before, entry], version)

    def remove(self, ids: DataFrame) -> int:
        """A version without the documents of ids(id)."""
        version, entries = self.versions.entries()
        gone = self._gone(entries, ids)
        return self.versions.commit(lambda old: [*old, gone], version)

    def _gone(self, entries: list[dict[str, Any]], ids: DataFrame) -> dict[str, Any]:
        name = self.versions.new_name()
        at = self.versions.batch(name)
        self._documents(entries).join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi").write.parquet(f"{at}/documents")
        made = self.spark.read.parquet(f"{at}/documents")
        made.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")).write.parquet(f"{at}/frequencies")
        n, texts, length = made.agg(F.count(F.lit(1)), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": name, "kind": "gone", "n": -n, "texts": -texts, "length": -length, "buckets": []}

    # ---- reading

    def _paths(self, entries: list[dict[str, Any]], kind: str, folder: str) -> list[str]:
        return [f"{self.versions.batch(e['name'])}/{folder}" for e in entries if e["kind"] == kind]

    def _documents(self, entries: list[dict[str, Any]]) -> DataFrame:
        """(id, toks, dl, run, place) of the documents that are there."""
        every = self.spark.read.parquet(*self._paths(entries, "rows", "documents"))
        gone = self._paths(entries, "gone", "documents")
        return every.join(broadcast_if_small(self.spark.read.parquet(*gone).select("run", "place")), ["run", "place"], "left_anti").select(*every.columns) if gone else every

    def index(self) -> Index:
        """The current version as sparse.search() takes it: statistics merged once, tokens unread."""
        version, entries = self.versions.entries()
        if not entries:
            raise ValueError(f"{self.versions.path}: nothing was added")
        if not self._opened or self._opened[0] != version:
            df = self.spark.read.parquet(*[f"{self.versions.batch(e['name'])}/frequencies" for e in entries]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            n, texts, length = (sum(e[c] for e in entries) for c in ("n", "texts", "length"))
            self._opened = version, _index(written(df, "frequencies"), self._documents(entries).select("id", "toks", "dl"), n, length / texts if texts else 0.0, self.k1, self.b)
        return self._opened[1]

    def blocks(self, buckets: list[int]) -> DataFrame:
        """The blocks in those folders; no other file is listed or read."""
        _, entries = self.versions.entries()
        paths = [f"{self.versions.batch(e['name'])}/postings/bucket={x}" for e in entries if e["kind"] == "rows" for x in buckets if x in e["buckets"]]
        schema = "term string, run string, places array<int>, tfs array<int>, dls array<int>, most int, least int"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score) of queries(query_id, text)."""
        index = self.index()
        _, entries = self.versions.entries()
        documents = self.spark.read.parquet(*self._paths(entries, "rows", "documents"))
        asked = written(weights(index, queries).withColumn("bucket", bucket_of(F.col("term"))), "weights")
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        terms = broadcast_if_small(asked.select("term").distinct())
        blocks = self.blocks(buckets).join(terms, "term", "left_semi")
        norm = lambda tf, dl: tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(index.mean_length or 1.0)))
        reach = F.greatest(F.col("w") * norm(F.col("most"), F.col("least")), F.lit(0.0))
        bounds = blocks.select("term", "run", "most", "least").join(broadcast_if_small(asked.select("query_id", "term", "w")), "term")
        bounds = written(bounds.groupBy("query_id", "run").agg((F.sum(reach) + 10.0**-DIGITS).alias("bound")).where(f"bound > {2 * 10.0**-DIGITS}"), "bounds")
        best = top_k(bounds, FIRST_RUNS, "bound", "run").select("query_id", "run")
        scored = written(self._scored(index, blocks, documents, entries, asked, best, k), "scored")
        worst = top_k(scored, k).groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_id", "worst")
        rest = bounds.join(best, ["query_id", "run"], "left_anti").join(worst, "query_id", "left").where("worst IS NULL OR bound >= worst").select("query_id", "run")
        more = self._scored(index, blocks, documents, entries, asked, written(rest, "rest"), k)
        return top_k(scored.unionByName(more).repartition("query_id", "id"), k).select("query_id", "rank", "id", "score")

    def _scored(self, index: Index, blocks: DataFrame, documents: DataFrame, entries: list[dict[str, Any]], asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """The k best (query_id, id, score) of each pair (query_id, run), unordered.  A run and what is asked of it meet in one task."""
        wanted = broadcast_if_small(pairs.select("run").distinct())
        found = blocks.join(wanted, "run", "left_semi").select("run", "term", "places", "tfs", "dls")
        of_run = pairs.join(broadcast_if_small(asked.select("query_id", "term", "w")), "query_id").join(found.select("run", "term").distinct(), ["run", "term"], "left_semi")
        lists = of_run.groupBy("run", "term").agg(F.collect_list("query_id").alias("query_id"), F.collect_list("w").alias("w"))
        both = found.join(lists, ["run", "term"])
        gone = self._paths(entries, "gone", "documents")
        empty = "run string, place int"
        dead = self.spark.read.parquet(*gone).select("run", "place").join(wanted, "run", "left_semi") if gone else self.spark.createDataFrame([], empty)
        schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("score", T.DoubleType())])
        placed = both.groupBy("run").cogroup(dead.groupBy("run")).applyInArrow(_scorer(k, index.k1, index.b, index.mean_length or 1.0, schema), schema)
        # ids of what was found alone
        return placed.join(documents.where("id IS NOT NULL").select("run", "place", "id"), ["run", "place"]).select("query_id", "id", "score")


def _children(versions: Snapshots, path: str) -> list[int]:
    target, files = versions._files(path)
    names = [x.getPath().getName() for x in files.listStatus(target)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _runs(name: str, most: int):
    """Number the documents of a task in runs.  Rows without an id are numbered too, since statistics count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        no = place = tokens = 0
        for batch in batches:
            runs, places = [], []
            for length in np.asarray(batch.column("dl").fill_null(0)).tolist():
                if place and (place >= most or tokens + length > RUN_TOKENS):
                    no, place, tokens = no + 1, 0, 0
                runs.append(f"{name}-{task}-{no}")
                places.append(place)
                place, tokens = place + 1, tokens + max(length, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.string()), pa.array(places, pa.int32())], names=["id", "toks", "dl", "run", "place"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of a task: of each run's rows in one batch, so that no more than a batch is held."""
    for batch in batches:
        toks = batch.column("toks")
        sizes = np.asarray(pa.compute.list_value_length(toks).fill_null(0))
        terms = toks.flatten().dictionary_encode()
        if not len(terms):
            continue
        many = len(terms.dictionary)
        doc = np.repeat(np.arange(len(batch)), sizes)
        runs = batch.column("run").dictionary_encode()
        # indices are of 32 bits, and terms times rows of one batch don't fit these
        run_of, term_of = np.asarray(runs.indices, np.int64), np.asarray(terms.indices, np.int64)
        cell, tf = np.unique((run_of[doc] * many + term_of) * len(batch) + doc, return_counts=True)
        group, doc = cell // len(batch), cell % len(batch)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place, dl = np.asarray(batch.column("place"))[doc], np.asarray(batch.column("dl"))[doc]
        offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, tf, dl)]
        yield pa.RecordBatch.from_arrays(
            [
                terms.dictionary.take(pa.array(group[first] % many)), runs.dictionary.take(pa.array(group[first] // many)), *lists,
                pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), pa.array(np.minimum.reduceat(dl, first).astype(np.int32)),
            ],
            names=["term", "run", "places", "tfs", "dls", "most", "least"],
        )


def _scorer(k: int, k1: float, b: float, mean: float, schema: T.StructType):
    def score(blocks: pa.Table, dead: pa.Table) -> pa.Table:
        none = to_arrow_schema(schema).empty_table()
        if not len(blocks):
            return none
        # what is asked of the run: each term once, though it may have several blocks
        blocks = blocks.combine_chunks().sort_by("term")
        terms = blocks["term"].combine_chunks().dictionary_encode()
        term_of = np.asarray(terms.indices)
        once = np.flatnonzero(np.diff(term_of, prepend=-1))
        lists = blocks.take(pa.array(once))
        sizes = np.asarray(pa.compute.list_value_length(lists["query_id"].combine_chunks()))
        known = _Weights(pa.table({"term": pa.array(np.repeat(np.asarray(terms.dictionary, object), sizes)), "query_id": lists["query_id"].combine_chunks().flatten(), "w": lists["w"].combine_chunks().flatten()}))
        flat = lambda c: np.asarray(blocks[c].combine_chunks().flatten())
        many = np.asarray(pa.compute.list_value_length(blocks["places"].combine_chunks()))
        place, tf, dl = flat("places"), flat("tfs").astype(np.float64), flat("dls")
        names = pa.compute.index_in(terms.dictionary, known.terms)
        term = np.asarray(names)[np.repeat(term_of, many)].astype(np.int64)
        alive = ~np.isin(place, np.asarray(dead["place"]))
        place, tf, dl, term = place[alive], tf[alive], dl[alive], term[alive]
        by = np.lexsort((term, place))
        place, tf, dl, term = place[by], tf[by], dl[by], term[by]
        value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
        found, doc = np.unique(place, return_inverse=True)
        best = Best(known.names, k)
        rows = min(BATCH, max(1, CELLS // max(1, len(known.names))))
        edges = np.searchsorted(doc, np.arange(0, len(found) + rows, rows))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            n = min(rows, len(found) - i * rows)
            if n <= 0:
                break
            scores = np.round(known.times(doc[lo:hi] - i * rows, term[lo:hi], value[lo:hi], n), DIGITS)
            scores[scores <= 0] = -np.inf
            best.add(scores, pa.array(found[i * rows : i * rows + n].astype(np.int32)))
        out = best.batches()
        if not out:
            return none
        hits = pa.Table.from_batches(out)
        return pa.table({"run": pa.array([blocks["run"][0].as_py()] * len(hits), pa.string()), "place": hits["id"], "query_id": hits["query_id"], "score": hits["score"]})

    return score
