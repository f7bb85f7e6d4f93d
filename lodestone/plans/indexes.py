"""Registered queries over written indexes: postings by term, batches added and removed, vectors in cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import CellIndex
from ..operators.postings import Postings
from ..sources.tables import folder
from . import catalog as cat
from .catalog import register, table


def _postings(spark, sf_dir: str) -> Postings:
    def make() -> Postings:
        index = Postings(spark, f"{folder(spark)}/postings/{uuid.uuid4().hex}")
        index.add(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
        return index

    return cat.once(spark, sf_dir, "postings", make)


@register(f"WITH {cat._BM25} SELECT * FROM {cat._top(10)}")
def bm25_postings(spark, sf_dir) -> DataFrame:
    """The hits of bm25_topk from the postings of the asked terms alone."""
    return _postings(spark, sf_dir).search(cat._bench(spark, sf_dir), 10)


_KEPT = "(SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || ' ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@register(f"WITH {cat.bm25_sql(_KEPT, 'doc_id')} SELECT * FROM {cat._top(10)}")
def incremental_index(spark, sf_dir) -> DataFrame:
    """Even documents, then all odd ones and new texts of some, then a removal: as if built anew from what is left."""
    d = table(spark, sf_dir, "documents")
    index = Postings(spark, f"{folder(spark)}/postings/{uuid.uuid4().hex}")
    index.add(d.where("doc_id % 2 = 0 OR doc_id % 4 = 1"), "doc_id", F.col("text"))
    changed = F.when(F.col("doc_id") % 4 == 1, F.concat_ws(" ", "text", "lang")).otherwise(F.col("text"))
    index.add(d.where("doc_id % 2 = 1").withColumn("text", changed), "doc_id", F.col("text"))
    index.remove(d.where("doc_id % 7 = 3").select(F.col("doc_id").alias("id")))
    return index.search(cat._bench(spark, sf_dir), 10)


def _cells(spark, sf_dir: str) -> CellIndex:
    def make() -> CellIndex:
        index = CellIndex(spark, f"{folder(spark)}/cells/{uuid.uuid4().hex}")
        index.build(cat._vectors(spark, sf_dir)[0], cells=16)
        return index

    return cat.once(spark, sf_dir, "cells", make)


@register(f"WITH {cat._DENSE} SELECT * FROM {cat._top(10, where='true')}")
def dense_cells(spark, sf_dir) -> DataFrame:
    """The hits of dense_topk from the cells that bounds don't exclude."""
    return _cells(spark, sf_dir).search(cat._vectors(spark, sf_dir)[1].select("query_id", "vector"), 10, probe=4)
