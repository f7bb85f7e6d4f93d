"""Benchmark decontamination by winnowing.

Every text has the hash of each run of K words; of each WINDOW neighbouring hashes the smallest is kept
as a fingerprint.  Of equal minima enough are kept that each window has one, so a text of one repeated
word has one in WINDOW words.  Two texts that share K + WINDOW - 1 = 13 words share the fingerprint of that
span, so a join of training and benchmark fingerprints misses no span.  A hit is extended to the windows of
13 words around it, and each of them is verified by its own hash: the words of verified windows are the
whole shared spans of 13 words or more.  An item of m < 13 words counts where all its m words occur; such
items are winnowed with K = m and a window of one.  All this is linear in the texts, repeated words included.

A benchmark of up to BLOCK_BYTES of text is broadcast, as sorted fingerprints, windows and the items of each
window, and joined by binary search: the corpus isn't shuffled.  A larger one is joined by shuffles: (fingerprint,
row, place) with the benchmark's fingerprints, the windows around the hits with its windows.  Neither way has the
benchmark or the corpus in one place, and results are the same.

Defined results.  Null and empty texts have no words, no hits and are clean.  Very long texts are handled
whole.  An item without words is never found.  Rows that repeat are judged alike; items that repeat an id count
once.  Items of null id mark words but have no id to list.  An empty table gives an empty table, an empty
benchmark no hits.  Ties: a text of which the hit words are exactly a twentieth is contaminated.  Ids may be of any type: they are listed as strings.  Extra columns of any name pass through;
results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as kn
from .rows import with_results
from .sqltext import column
from .store import materialize

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
BLOCK_BYTES = 16 << 20  # of benchmark text: some 2.5 million words, 60 MB of arrays
PAIRS = 1 << 20  # (text, item) pairs that are worked out at once


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of texts with at least k + window - 1 words."""
    n = len(hashes)
    g = kn.grams(hashes, k)
    whole = kn.inside(first, k + window - 1, n)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.where(whole, kn.sliding_min(g, window)[: len(whole)], np.uint64(0))
    # a place can be kept where it is the minimum of one of its windows, so where the largest of their minima is its own hash
    room = np.zeros(len(g) + window - 1, np.uint64)
    room[window - 1 : window - 1 + len(least)] = least
    at = np.flatnonzero((kn.sliding_max(room, window) == g) & (g > 0))
    at = at[_enough(at, g[at], window)]
    return at, g[at]


def _enough(at: np.ndarray, value: np.ndarray, window: int) -> np.ndarray:
    """Of equal minima that lie in one window: the first, and from each kept one the farthest that the next window has."""
    tied = np.flatnonzero((value[1:] == value[:-1]) & (np.diff(at) < window)) if len(at) else at
    keep = np.ones(len(at), bool)
    if not len(tied):
        return keep
    starts = tied[np.concatenate(([True], np.diff(tied) > 1))]
    ends = tied[np.concatenate((np.diff(tied) > 1, [True]))] + 1
    for s, e in zip(starts.tolist(), ends.tolist()):
        keep[s : e + 1] = False
        keep[s] = True
        i = s
        while i < e:
            i = int(np.searchsorted(at[i + 1 : min(e, i + window) + 1], at[i] + window, side="right")) + i
            keep[i] = True
    return keep


def runs(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m words from each place on: those of kn.grams at these places."""
    h = hashes[at].copy()
    for j in range(1, m):
        h *= kn._GRAM
        h += hashes[at + j]
    return kn.mix(h)


def shape(m: int) -> tuple[int, int]:
    """K and window for items of m words, m = SPAN for all longer ones."""
    return (K, WINDOW) if m == SPAN else (m, 1)


def around(at: np.ndarray, m: int, first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of m words that hold a hit at one of these places and stay in their text."""
    window = shape(m)[1]
    ok = kn.inside(first, m, n)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.maximum(at - (window - 1), 0), 1)
    np.add.at(delta, at + 1, -1)
    return np.flatnonzero((np.cumsum(delta)[: len(ok)] > 0) & ok)


def find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted values are there, and where."""
    if not len(sorted_):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    where = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[where] == wanted, where


def item_windows(w: kn.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(m, fingerprints, window hashes, item of each window) for each m that items have."""
    sizes = np.diff(w.first)
    need = np.minimum(sizes, SPAN)
    for m in sorted(set(need[need > 0].tolist())):
        at, fp = winnow(w.hashes, w.first, *shape(m))
        own = need[np.searchsorted(w.first, at, side="right") - 1] == m
        start = np.flatnonzero(kn.inside(w.first, m, len(w)))
        item = np.searchsorted(w.first, start, side="right") - 1
        start, item = start[need[item] == m], item[need[item] == m]
        yield m, np.unique(fp[own]), runs(w.hashes, start, m), item


class Block:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        self.ids = ids
        self.kinds = []
        for m, fps, windows, items in item_windows(_words(pa.array(texts, pa.string()))):
            order = np.lexsort((items, windows))
            windows, items = windows[order], items[order]
            fresh = np.ones(len(windows), bool)
            fresh[1:] = (windows[1:] != windows[:-1]) | (items[1:] != items[:-1])
            windows, items = windows[fresh], items[fresh]
            distinct, first = np.unique(windows, return_index=True)
            self.kinds.append((m, fps, distinct, np.append(first, len(windows)), items.astype(np.int32)))

    def hits(self, w: kn.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words are hit, and (text, item) pairs."""
        n = len(w)
        hit = np.zeros(n, bool)
        pairs = np.zeros(0, np.int64)
        for m, fps, windows, first, items in self.kinds:
            at, fp = winnow(w.hashes, w.first, *shape(m))
            start = around(at[find(fps, fp)[0]], m, w.first, n)
            if not len(start):
                continue
            there, where = find(windows, runs(w.hashes, start, m))
            start, where = start[there], where[there]
            mask = np.zeros(n, bool)
            mask[start] = True
            hit |= kn.spread(mask, m, n)
            text = np.searchsorted(w.first, start, side="right") - 1
            both = np.unique(text * len(windows) + where)
            text, where = both // len(windows), both % len(windows)
            size = first[where + 1] - first[where]
            past = np.cumsum(size)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(past, (past[i - 1] if i else 0) + PAIRS)))
                one = np.repeat(text[i:j], size[i:j]) * len(self.ids)
                offset = np.arange(len(one)) - np.repeat(np.concatenate(([0], np.cumsum(size[i:j])[:-1])), size[i:j])
                pairs = np.union1d(pairs, one + items[np.repeat(first[where[i:j]], size[i:j]) + offset])
                i = j
        return hit, [(p // len(self.ids), p % len(self.ids)) for p in pairs.tolist()]


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))
RESULTS = {"n_words": T.LongType(), "hit_spans": _SPAN, "items": T.ArrayType(T.StringType())}
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _words(texts: pa.Array) -> kn.Words:
    return kn.Words(*kn.utf8(texts), kn.ALNUM, kn.FOLD)


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return [{"first": s, "past": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_spans (word ranges, end exclusive) and items (ids as strings, sorted).

    carry: the input columns that the result has (all, where None).
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    bench = bench.select(column(item).cast("string").alias("item"), column(item_text).alias("text"))
    rows, size = bench.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if (size or 0) + 16 * rows > block_bytes:
        return _by_join(docs, bench, text, keep)
    found = bench.collect()
    return _by_block(docs, Block([r["item"] for r in found], [r["text"] for r in found]), text, keep)


def _by_block(docs: DataFrame, block: Block, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def work(texts: pa.Array) -> list[pa.Array]:
        w = _words(texts)
        hit, pairs = shared.value.hits(w)
        spans: list = [[] for _ in range(len(texts))]
        found: list = [set() for _ in range(len(texts))]
        for t, i in pairs:
            name = shared.value.ids[i]
            if name is not None:
                found[t].add(name)
        for t in np.flatnonzero(kn.per_text(hit, w.first)).tolist():
            spans[t] = _spans(hit[w.first[t] : w.first[t + 1]])
        return [pa.array(np.diff(w.first).astype(np.int64)), pa.array(spans, _SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

    return with_results(docs, text, keep, RESULTS, work)


def _by_join(docs: DataFrame, bench: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The same for a benchmark of any size.  Rows are numbered in a table that is written once."""
    items = materialize(bench.mapInArrow(_item_rows, "m int, fingerprint boolean, hash long, item string"), "items")
    kinds = sorted(r["m"] for r in items.select("m").distinct().collect())  # 13 at most
    fps = items.where("fingerprint").select("m", "hash").distinct()
    windows = items.where("NOT fingerprint").select("m", "hash", "item").distinct()
    rows = materialize(docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)], column(text).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")

    prints = rows.select("row", "text").mapInArrow(lambda b: _row_prints(b, kinds), "row long, m int, pos long, hash long")
    hits = prints.join(fps, ["m", "hash"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("m", "pos")).alias("hits"))
    near = rows.select("row", "text").join(hits, "row").mapInArrow(_row_windows, "row long, m int, pos long, hash long")
    near = materialize(near, "windows")
    # windows of one text that repeat find the same items
    named = near.select("row", "m", "hash").distinct().join(windows, ["m", "hash"]).where("item IS NOT NULL").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = near.join(windows.select("m", "hash").distinct(), ["m", "hash"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("pos", "m")).alias("starts"))
    found = rows.join(spans, "row", "left").join(named, "row", "left")
    carried = [f"c{i}" for i in range(len(keep))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = kn.utf8(whole.column("text"))
            for i, j in kn.slices(offsets):
                batch = whole.slice(i, j - i)
                sizes = np.diff(_words(batch.column("text")).first)
                spans = []
                for n, starts in zip(sizes.tolist(), batch.column("starts").to_pylist()):
                    hit = np.zeros(n, bool)
                    for s in starts or ():
                        hit[s["pos"] : s["pos"] + s["m"]] = True
                    spans.append(_spans(hit) if starts else [])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*carried, "items")] + [pa.array(sizes.astype(np.int64)), pa.array(spans, _SPANS)], names=[*carried, "items", "n_words", "hit_spans"])

    none = F.array().cast("array<string>")
    schema = T.StructType([found.schema[c] for c in (*carried, "items")] + [T.StructField(c, RESULTS[c]) for c in ("n_words", "hit_spans")])
    out = found.mapInArrow(finish, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "hit_spans", F.coalesce("items", none).alias("items"))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        _, offsets = kn.utf8(whole.column("text"))
        for i, j in kn.slices(offsets):
            batch = whole.slice(i, j - i)
            for m, fps, windows, items in item_windows(_words(batch.column("text"))):
                names = batch.column("item").take(pa.array(items))
                for mark, hashes, ids in ((True, fps, pa.nulls(len(fps), pa.string())), (False, windows, names)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), m, np.int32)), pa.array([mark] * len(hashes)), pa.array(hashes.view(np.int64)), ids], names=["m", "fingerprint", "hash", "item"])


def _places(row: pa.Array, w: kn.Words, at: np.ndarray, m: int, hashes: np.ndarray) -> pa.RecordBatch:
    text = np.searchsorted(w.first, at, side="right") - 1
    return pa.RecordBatch.from_arrays([row.take(pa.array(text)), pa.array(np.full(len(at), m, np.int32)), pa.array(at - w.first[text]), pa.array(hashes.view(np.int64))], names=["row", "m", "pos", "hash"])


def _row_prints(batches: Iterator[pa.RecordBatch], kinds: list[int]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        _, offsets = kn.utf8(whole.column("text"))
        for i, j in kn.slices(offsets):
            batch = whole.slice(i, j - i)
            w = _words(batch.column("text"))
            for m in kinds:
                at, fp = winnow(w.hashes, w.first, *shape(m))
                yield _places(batch.column("row"), w, at, m, fp)


def _row_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        _, offsets = kn.utf8(whole.column("text"))
        for i, j in kn.slices(offsets):
            batch = whole.slice(i, j - i)
            w = _words(batch.column("text"))
            of_row = batch.column("hits")
            text = np.repeat(np.arange(len(batch)), np.asarray(of_row.value_lengths()))
            kind, pos = (np.asarray(x) for x in of_row.flatten().flatten())
            for m in np.unique(kind).tolist():
                start = around(np.sort(pos[kind == m] + w.first[text[kind == m]]), m, w.first, len(w))
                yield _places(batch.column("row"), w, start, m, runs(w.hashes, start, m))


def judge(found: DataFrame) -> DataFrame:
    """contamination() with n_hit, n_items and the verdict: a twentieth of the words or more are hit."""
    return (
        found.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["past"] - x["first"]))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT m FROM b),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
