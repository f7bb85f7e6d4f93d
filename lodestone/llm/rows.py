"""Results of whole texts beside the columns of their rows, in one narrow pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as kn
from .sqltext import column


def with_results(docs: DataFrame, text: str, keep: list[str], results: dict[str, T.DataType], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns keep of docs and the results, which work gives for the texts of some rows.

    work sees about kernel.SLICE_BYTES of text at once, a longer text alone.  Columns travel under numbers,
    so that their names can be any.
    """
    rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)], column(text).alias("text"))
    own = [f"c{i}" for i in range(len(keep))]
    new = [f"r{i}" for i in range(len(results))]
    schema = T.StructType([rows.schema[c] for c in own] + [T.StructField(n, kind) for n, kind in zip(new, results.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = kn.utf8(whole.column("text"))
            for i, j in kn.slices(offsets):
                batch = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + work(batch.column("text")), names=[*own, *new])
            kn.release()

    out = rows.mapInArrow(run, schema)
    return out.select(*[out[n].alias(c) for n, c in zip([*own, *new], [*keep, *results])])
