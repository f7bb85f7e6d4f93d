"""Service metrics of the latest requests of each group, kept as state of a stream of traces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = 1000  # requests of a group that count


def percentile(ordered: list[float], q: float) -> float:
    """The value at the half-even rounded index q * (n - 1), as operators.metrics.service_percentile() has it."""
    return ordered[round(q * (len(ordered) - 1))] if ordered else 0.0


def latest_latencies(traces: DataFrame, time: str, by: str, value: str, latest: int = LATEST) -> DataFrame:
    """(by, requests, p50, p95) over the latest requests of each group, told anew after every batch in which the group has some.

    A group's state is the times and values of at most so many requests, whatever has come before; late rows take their place by time, and
    of rows of one time the larger values count as later.  Rows without a group, a time or a value are left out.
    """
    rows = traces.select(F.col(by).alias("by"), F.col(time).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where("by IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL")
    out = T.StructType([T.StructField(by, rows.schema["by"].dataType), T.StructField("requests", T.LongType()), T.StructField("p50", T.DoubleType()), T.StructField("p95", T.DoubleType())])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held += zip(((part["at"].astype("datetime64[us]").astype("int64")).tolist()), part["value"].tolist())
            held = sorted(held)[-latest:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        ordered = sorted(v for _, v in held)
        yield pd.DataFrame([(key[0], len(held), percentile(ordered, 0.5), percentile(ordered, 0.95))], columns=out.names)

    return rows.groupBy("by").applyInPandasWithState(update, out, "times array<long>, amounts array<double>", "update", GroupStateTimeout.NoTimeout)


def run_to_latest(stream: DataFrame, by: str, path: str, checkpoint: str) -> None:
    """Process what is there, append each batch's rows with their batch number to a table, and stop; latest_of() reads what holds now."""

    def save(rows: DataFrame, batch: int) -> None:
        # a batch that is done again after a failure takes the place of its first try
        rows.withColumn("told", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of(told: DataFrame, by: str) -> DataFrame:
    """The last row of each group in a table that run_to_latest() writes."""
    others = [c for c in told.columns if c not in (by, "told", "batch")]
    return told.groupBy(by).agg(F.max_by(F.struct(*others), "told").alias("r")).select(by, "r.*")
