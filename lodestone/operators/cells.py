"""A vector index in cells: every vector lies in the folder of its nearest coarse centroid, and a search reads few of them.

Centroids are fitted on a sample of at most SAMPLE rows, on the driver; every row is indexed.  A search first reads the cells nearest to
its queries.  Then it may stop, with the recall that tests measure, or go on to those cells that can still hold a better hit: of vectors
within an angle r of their centroid none is nearer to a query than the centroid's angle less r.  So the exact search gives the
rows of dense.search() and reads the others' folders only where bounds can't exclude them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sized import in_blocks
from ..sources.tables import written
from .dense import CELLS as SCORES
from .dense import NUMBERS, matrix, normalised
from .ranking import DIGITS, Best, hit_schema, top_k

SAMPLE = 20_000  # rows that centroids are fitted on
ROUNDS = 8
PROBE = 8
SLACK = 1e-6  # of an angle, above its rounding


def fit(vectors: DataFrame, vector: str, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of length one, fitted on at most SAMPLE rows; fewer where there are fewer different rows."""
    known = vectors.where(F.col(vector).isNotNull())
    n = known.count()
    drawn = known.sample(min(1.0, 1.2 * SAMPLE / n), seed) if n > SAMPLE else known
    x = normalised(matrix(drawn.select(F.col(vector).alias("v")).limit(SAMPLE).toArrow()["v"].combine_chunks()))
    x = np.unique(x, axis=0) if len(x) else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        has = np.bincount(near, minlength=len(c)) > 0
        c[has] = normalised(sums[has])
    return c


class CellIndex:
    """The index at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, id_: str = "id", vector: str = "vector", cells: int = 64) -> None:
        """Write all rows that have an id and a vector, by cell; then the cells' centroids, sizes and radii."""
        rows = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
        c = fit(rows, "vector", cells)
        shared = self.spark.sparkContext.broadcast(c)
        schema = T.StructType([rows.schema["id"], rows.schema["vector"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        placed = rows.mapInArrow(_placer(shared), schema)
        placed.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{self.path}/rows")
        made = self.spark.read.parquet(f"{self.path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        about = {r["cell"]: (r["n"], r["radius"]) for r in made.collect()}
        facts = [(i, *about[i], json.dumps(c[i].tolist())) for i in sorted(about)]
        self.spark.createDataFrame(facts, "cell int, n long, radius double, centroid string").coalesce(1).write.parquet(f"{self.path}/cells")

    def _rows(self, cells: list[int], schema: T.StructType) -> DataFrame:
        """The rows of these cells; no other folder is listed."""
        parts = [f"{self.path}/rows/cell={x}" for x in cells]
        own = T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])
        return self.spark.read.schema(own).option("basePath", f"{self.path}/rows").parquet(*parts) if parts else self.spark.createDataFrame([], own)

    def search(self, queries: DataFrame, k: int, probe: int = PROBE, exact: bool = True) -> DataFrame:
        """(query_id, rank, id, score) of queries(query_id, vector): exactly dense.search()'s, or the best of the nearest probe cells."""
        found = None
        facts = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        names = [r["cell"] for r in facts]
        c, radius = np.array([json.loads(r["centroid"]) for r in facts]), np.array([r["radius"] for r in facts])
        kinds = self.spark.read.parquet(f"{self.path}/rows").schema
        rows = T.StructType([kinds["id"], kinds["vector"]])
        hits = hit_schema(queries.schema["query_id"].dataType, kinds["id"].dataType)
        wide = max(1, c.shape[1] if len(c) else 1)
        for block in in_blocks(queries.select("query_id", "vector").where("vector IS NOT NULL"), max(1, NUMBERS // wide)):
            q = normalised(np.array([r["vector"] for r in block], np.float64))
            ids = pa.array([r["query_id"] for r in block], to_arrow_type(hits["query_id"].dataType))
            angle = np.arccos(np.clip(q @ c.T, -1, 1))
            wanted = np.zeros(angle.shape, bool)
            np.put_along_axis(wanted, np.argsort(angle, axis=1, kind="stable")[:, :probe], True, axis=1)
            part = self._scored(names, wanted, q, ids, rows, hits, k)
            if exact and not wanted.all():
                part = written(part, "near")
                place = {r["query_id"]: r["worst"] for r in top_k(part, k).groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
                worst = np.array([place.get(r["query_id"], -2.0) for r in block])
                bound = np.round(np.cos(np.maximum(angle - radius - SLACK, 0)), DIGITS) + 10.0**-DIGITS
                bound[np.linalg.norm(q, axis=1) == 0] = 1.0  # angles say nothing of a zero vector
                part = part.unionByName(self._scored(names, (bound >= worst[:, None]) & ~wanted, q, ids, rows, hits, k))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], hits).select("query_id", F.lit(0).alias("rank"), "id", "score")
        return top_k(found.repartition("query_id", "id"), k).select("query_id", "rank", "id", "score")

    def _scored(self, names: list[int], wanted: np.ndarray, q: np.ndarray, ids: pa.Array, rows: T.StructType, hits: T.StructType, k: int) -> DataFrame:
        cells = [names[i] for i in np.flatnonzero(wanted.any(axis=0))]
        shared = self.spark.sparkContext.broadcast(({name: wanted[:, i] for i, name in enumerate(names) if wanted[:, i].any()}, q, ids))
        return self._rows(cells, rows).mapInArrow(_scorer(shared, k), hits)


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = normalised(matrix(batch.column("vector"))) @ shared.value.T
            cell = near.argmax(axis=1)
            # a zero vector has no angle: its cell may hold what is at a right angle to everything
            angle = np.where(np.abs(near).max(axis=1) == 0, np.pi, np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "vector", "cell", "angle"])

    return run


def _scorer(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, q, ids = shared.value
        best = Best(ids, k)
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                score = np.round(normalised(matrix(batch.column("vector"))) @ q.T, DIGITS)
                cell = np.asarray(batch.column("cell"))
                for c in np.unique(cell).tolist():
                    score[np.ix_(cell == c, ~wanted[c])] = -np.inf
                best.add(score, batch.column("id"))
        yield from best.batches()

    return run
