"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else a shuffle join stays the planner's choice."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer splits than these: a file of one row group is one task otherwise.
    Larger tables stay as they are, so that no corpus is shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def in_blocks(df: DataFrame, rows: int):
    """Rows of df in lists of at most so many; one list is on the driver at a time."""
    block = []
    for row in df.toLocalIterator():
        block.append(row)
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block
