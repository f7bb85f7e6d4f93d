"""Centroid clustering of integer vectors: Lloyd rounds with block-norm screening.

A vector is kept with the norms of its segments beside it.  By Cauchy and Schwarz the product of two vectors is at most the
product of their segments' norms, so sum((|x_s| - |c_s|)^2) over the segments s bounds the squared distance from below.  A task
works these bounds out for a batch and all centroids as one small matrix product, then takes the centroids of each
vector in the order of their bounds and gives exact integer distances only until a bound exceeds the best distance so far.  That saves much
where vectors lie in groups and nothing where they are spread evenly over a sphere; results are the same.

The integer vectors and their norms are written once; a round is one scan of that table, which sends at most one row of sums a centroid
and task.  The driver holds centroids and their sums: centroids x components numbers, whatever the number of vectors.

Defined results.  Null vectors, vectors of another length and those with a null or non-finite component are left out.  A null id is
a row like any other, but no first centroid.  Rows that repeat are rows of their own; rows that tie for a first centroid are
ordered by their vectors; where no row has an id, one centroid starts at zero.  Of equally near centroids the one with the smallest number is taken.  Fewer vectors than centroids: each starts one.  An
empty table gives an empty table.  Only the id and the vector are read, so other columns never clash.  A component of which the integer
would have 27 bits or more raises an error: distances would no longer fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sqltext import column
from .store import materialize, scratch

SCALE, MOST_BITS = 256, 26
SEGMENT = 4  # components of a segment
ROWS = 4096  # vectors that are compared at once
MARGIN = 1e-6  # of both squared norms: above the rounding of norms that are kept as floats


def integers(vector: Column, dim: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector is to be left out."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.exists(scaled, lambda x: F.abs(x) >= F.lit(float(1 << MOST_BITS)))
    whole = F.transform(scaled, lambda x: F.floor(x).cast("int"))
    return F.when(usable, F.when(large, F.raise_error(F.lit(f"a component times {scale} has more than {MOST_BITS} bits"))).otherwise(whole))


def rows_of(column_: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column_.flatten()).astype(kind).reshape(len(column_), -1)


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norms of the segments of each row, the last one filled with zeros."""
    wide = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % segment)))
    return np.sqrt((wide.reshape(len(x), -1, segment) ** 2).sum(axis=2))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, squared distance, exact distances worked out) of each row of integers x; norms: segment_norms(x)."""
    own, theirs = norms.astype(np.float64), segment_norms(centroids)
    squares = (own**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1)[None, :]
    bound = squares - 2 * own @ theirs.T - MARGIN * squares - 1
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    cluster = np.full(len(x), len(centroids))
    seen = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for t in range(len(centroids)):
        c = order[rows, t]
        open_ = bound[rows, c] <= best[rows]
        rows, c = rows[open_], c[open_]
        if not len(rows):
            break
        apart = x[rows] - centroids[c]
        distance = np.einsum("ij,ij->i", apart, apart)
        better = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = distance[better], c[better]
        seen[rows] += 1
    return cluster, best, seen


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for i in range(0, len(whole), ROWS):
            batch = whole.slice(i, ROWS)
            yield batch, rows_of(batch.column("v"), np.int64), rows_of(batch.column("norms"), np.float32)


def _with_norms(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(rows_of(batch.column("v"), np.int64), segment).astype(np.float32) if len(batch) else np.zeros((0, 1), np.float32)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * norms.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(norms.ravel()))], names=["id", "v", "norms"])

    return run


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        count = np.zeros(len(centroids), np.int64)
        for _, x, norms in _parts(batches):
            cluster = nearest(x, norms, centroids)[0]
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=len(centroids))
        has = np.flatnonzero(count)
        offsets = pa.array(np.arange(len(has) + 1, dtype=np.int32) * total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(count[has]), pa.ListArray.from_arrays(offsets, pa.array(total[has].ravel()))], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, norms in _parts(batches):
            cluster, distance, seen = nearest(x, norms, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(seen.astype(np.int32))], names=["id", "cluster", "distance", "n_exact"])

    return run


def cluster(vectors: DataFrame, k: int, rounds: int, id_: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = SCALE, salt: str = "2:", segment: int = SEGMENT) -> DataFrame:
    """(id, cluster, distance, n_exact, cluster_inertia, inertia, centroid): every kept vector with its final centroid.

    The first centroids are the vectors of which the salted ids have the smallest SHA-256.  n_exact: how many centroids the
    screening left for an exact distance.  centroid: the components of the final centroid, joined by commas.
    """
    spark = vectors.sparkSession
    kept = vectors.select(column(id_).alias("id"), integers(column(vector), dim, scale).alias("v")).where("v IS NOT NULL")
    with scratch() as keep:
        schema = T.StructType([kept.schema["id"], kept.schema["v"], T.StructField("norms", T.ArrayType(T.FloatType()))])
        table = materialize(kept.mapInArrow(_with_norms(segment), schema), "vectors")
        drawn = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h")
        first = table.select(drawn, "v").where("h IS NOT NULL").orderBy("h", "v").limit(k).collect()
        centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
        if not len(first):
            centroids = np.zeros((1, dim), np.int64)  # rows without ids only, or none at all: one centroid, which the first round moves
        for _ in range(rounds):
            sums = table.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
            found = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect()
            for r in found:
                centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        placed = T.StructType([kept.schema["id"], *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("n_exact", T.IntegerType())))])
        out = materialize(table.mapInArrow(_assign(centroids), placed), "clustered")
        keep.append(out)
    per = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = [(i, per.get(i, 0), sum(per.values()), ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    return out.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid string")), "cluster").select(F.col("id").alias(id_), "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 40, 5)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds one after the other, all distances exact."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT vec_id, x.v, min(struct_pack(distance := CAST({apart} AS BIGINT), cluster := CAST(c.cluster AS INTEGER))) AS best FROM kept x CROSS JOIN c{i} c GROUP BY vec_id, x.v)"
        )
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM d{i})")
            parts.append(f"m{i} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM s{i} GROUP BY cluster, dim)")
            parts.append(f"l{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS v FROM m{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(l.v, c.v) AS v FROM c{i} c LEFT JOIN l{i} l USING (cluster))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.cluster AS cluster, best.distance AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM d{rounds} d JOIN c{rounds} c ON c.cluster = d.best.cluster"""
    )


OP13_SQL = _sql()
