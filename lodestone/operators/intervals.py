"""Joins of ranges: those of one key that overlap, each pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 8  # of a bin: ranges here are pages, mostly one or a few


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], of_left: tuple[str, str], of_right: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal keys of which the ranges (first, last) share a point.

    A range stands in every bin that it touches, and ranges meet in the first bin that both touch.  Keys and bins are joined by
    equality, so that a key with very many rows is split over tasks.  A range without a bound, or one that ends before it begins, has no
    pairs.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")

    def dealt(rows: DataFrame, first: str, last: str) -> DataFrame:
        bins: Column = F.sequence(at(first), at(last))
        return rows.where(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(bins))

    both = dealt(left, *of_left).join(dealt(right, *of_right), [*keys, "_bin"])
    shared = (F.col(of_left[0]) <= F.col(of_right[1])) & (F.col(of_right[0]) <= F.col(of_left[1]))
    return both.where(shared & (F.col("_bin") == F.greatest(at(of_left[0]), at(of_right[0])))).drop("_bin")
