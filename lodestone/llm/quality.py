"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed features: every word, every character n-gram of
NGRAMS lengths inside a word and its bounding spaces, and for each word that one of the REPEATS words
before it equals a word n-gram that names only how far back.  A
softmax over the average gives the class.  Vectors and output weights are trained together by plain
stochastic gradient descent in numpy, with a falling learning rate, on at most TRAIN_DOCS labelled
documents (those with the smallest hash of the id): a classifier fit on a bounded sample.

The output is linear in the average, so that for scoring each bucket's vector is folded with the output
weights into one number; a document's score is then exact from one lookup a feature.

Defined results.  Null and empty texts, and texts of white space only, have no features and get the
class balance that training saw.  Very long texts are scored whole.  Without labelled rows every score is 0.5.
Labels other than 0 and 1 and labels of unknown documents are not learned; a document with several labels
learns each.  Rows that repeat get the same score; a score of exactly the threshold is predicted 1.  An empty
table gives an empty table.  Columns of the input, of any name, pass through; results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as kn
from .rows import with_results
from .sqltext import column

BUCKETS = 1 << 18
NGRAMS = (3, 4)
REPEATS = 4
DIM = 8
EPOCHS = 6
RATE = 0.3
TRAIN_DOCS = 2400
THRESHOLD = 0.7

_SPACE = ~kn.NOT_SPACE


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, bucket) of each feature, ascending by position, and the positions at which the texts begin and end."""
    w = kn.Words(data, offsets, kn.NOT_SPACE)
    yield w.starts, (w.hashes >> np.uint64(64 - 18)).astype(np.int32), offsets
    for d in range(1, min(REPEATS, len(w) - 1) + 1):
        same = np.flatnonzero((w.hashes[d:] == w.hashes[:-d]) & kn.inside(w.first, d + 1, len(w)))
        yield w.starts[same + d], np.full(len(same), (0x51ED27 * d) % BUCKETS, np.int32), offsets
    wide = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    blank = _SPACE[np.minimum(wide, 255)] & (wide < 128)
    wide = np.where(blank, np.uint32(32), wide)
    n = len(wide)
    for k in NGRAMS:
        if n < k:
            continue
        ok = kn.inside(edges, k, n)
        h = np.full(n - k + 1, 0x9E37 + k, np.uint32)
        for j in range(k):
            h *= np.uint32(0x01000193)
            h ^= wide[j : j + len(h)]
            if 0 < j < k - 1:
                ok &= ~blank[j : j + len(h)]
        h *= np.uint32(0x85EBCA6B)
        at = np.flatnonzero(ok)
        yield at, (h[at] >> np.uint32(32 - 18)).astype(np.int32), edges


class Model:
    """weights: the score that a feature of each bucket adds to the average; bias: that of none."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for at, bucket, edges in features(data, offsets):
            run = np.concatenate(([0.0], np.cumsum(self.weights[bucket], dtype=np.float64)))
            edge = np.searchsorted(at, edges)
            total += run[edge[1:]] - run[edge[:-1]]
            count += np.diff(edge)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features, and how many fall into each."""
    found = [b for _, b, _ in features(*kn.utf8(pa.array([text], pa.string())))]
    ids, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int32)]), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 11) -> Model:
    """Stochastic gradient descent, one document a step."""
    if not bags:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    shares = [(ids, (counts / max(1, counts.sum())).astype(np.float32)) for ids, counts in bags]
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    prior = (sum(labels) + 1) / (len(labels) + 2)
    bias[1] = np.log(prior / (1 - prior))
    steps, done = epochs * len(shares), 0
    for _ in range(epochs):
        for i in rng.permutation(len(shares)):
            ids, share = shares[i]
            step = rate * (1 - done / steps)
            done += 1
            mine = vectors[ids]
            mean = share @ mine
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            # a feature's own gradient is its share of the average; scaled by the number of features, as rare ones would never move
            vectors[ids] = mine - (step * np.minimum(share * len(ids), 4.0) / 8)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


_BAG = {"ids": T.ArrayType(T.IntegerType()), "counts": T.ArrayType(T.IntegerType())}


def _bags(texts: pa.Array) -> list[pa.Array]:
    found = [bag(t or "") for t in texts.to_pylist()]
    return [pa.array([x.tolist() for x in side], pa.list_(pa.int32())) for side in (list(zip(*found)) or [(), ()])]


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most max_docs labelled documents among the rows of labels that are usable.  Their features, not their texts,
    reach the driver: a number for each of a document's buckets, of which there are BUCKETS."""
    known = labels.where(usable & column(label).isin(0, 1)).select(column(key).alias("k"), column(label).cast("int").alias("y")).where("k IS NOT NULL")
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < min(1.0, (1.3 * max_docs + 50) / max(1, n)) * (1 << 20))
    # of bounded size: about 1.3 * max_docs rows
    rows = docs.select(column(key).alias("k"), column(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(some), "k").withColumn("h", F.xxhash64("k"))
    found = with_results(rows, "t", ["h", "k", "y"], _BAG, _bags).toArrow()
    order = sorted(zip(*(found[c].to_pylist() for c in ("h", "k", "y")), range(len(found))), key=lambda r: (r[0] % (1 << 20), *r[:3]))[:max_docs]
    ids, counts = (found[c].combine_chunks() for c in _BAG)
    return fit([(ids[i].values.to_numpy(), counts[i].values.to_numpy()) for *_, i in order], [y for _, _, y, _ in order])


RESULTS = {"score": T.DoubleType(), "predicted": T.IntegerType()}


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        s = shared.value.scores(*kn.utf8(texts))
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return with_results(docs, text, keep, RESULTS, work)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    out = score(docs, model, carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
