"""Periodic runs of words: the runs theorem over all texts of a batch at once.

Every run has a Lyndon root that is the longest Lyndon word at its start, in the order of the words or in the reverse order.  The
longest Lyndon word at a position ends before the next position of which the suffix is smaller: the next smaller value of the
inverse suffix array.  Each root is extended to both sides by longest common prefixes, of suffixes to the right and of
suffixes of the reversed text to the left, which are minima of the LCP array over a range: a sparse table gives them.
Roots that extend to two periods and the least length are runs; equal ones are one run.  Where all roots of a text end within the
least length on both sides, they are compared word by word and no such arrays are made for it.

Suffix arrays come from prefix doubling, in which only suffixes that still tie are sorted again.  A word is a symbol of its own in
each text, so no suffix reaches over the end of its text.  LCP values are worked out where they don't follow from their left
neighbour, the sum of which is O(n log n); a level of the sparse table is held at a time.  Memory is 160 to 200 bytes a word
of the longest text or, for shorter texts, of 1 MB of them.

Words are compared by 64-bit hashes.  Texts are whole, one narrow pass, nothing is shuffled.

Defined results.  Null, empty and blank texts have no words, no runs and nothing kept.  Null ids are rows like any other, rows that
repeat have equal results.  Runs of the same length: the smallest start, then the smallest period comes first.  An empty table gives an
empty table.  Only the columns to keep and the text are read, under numbers, so that names never clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from . import kernel as kn
from .rows import with_results

LEAST = 12  # words of a run
DIRECT = 64  # symbols that are compared for all pairs at once; the few longer matches are compared one by one


def suffix_ranks(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of symbols in ranges that end at end[i]; a suffix ends with its range, and an end is smaller than all."""
    n = len(symbols)
    order = np.argsort(symbols)
    rank = np.empty(n, np.int64)

    def number(slots: np.ndarray, positions: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give positions, in the order of keys, the first slot of their equals; the slots that are still shared."""
        new = np.empty(len(keys), bool)
        new[:1] = True
        new[1:] = keys[1:] != keys[:-1]
        rank[positions] = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        alone = new & np.append(new[1:], True)
        return slots[~alone]

    open_ = number(np.arange(n), order, symbols[order])
    k = 1
    while len(open_):
        at = order[open_]
        after = at + k
        behind = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[at] * (n + 1) + behind
        by = np.argsort(keys)
        order[open_] = at[by]
        open_ = number(open_, at[by], keys[by])
        k *= 2
    return order, rank


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix in order and the one before it.  symbols of different texts differ."""
    n = len(symbols)
    previous = np.empty(n, np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = n
    wide = np.append(symbols, -1)
    a = np.arange(n)
    left_equal = np.zeros(n, bool)
    left_equal[1:] = (previous[1:] > 0) & (previous[1:] < n) & (symbols[:-1] == wide[previous[1:] - 1])
    own = np.flatnonzero(~left_equal)  # the others have the value of their left neighbour less one
    length = np.zeros(n, np.int64)
    i, j = a[own], previous[own]
    inside = j < n
    where, i, j = own[inside], i[inside], j[inside]
    for t in range(DIRECT):
        if not len(where):
            break
        length[where] = t
        same = wide[np.minimum(i + t, n)] == wide[np.minimum(j + t, n)]
        where, i, j = where[same], i[same], j[same]
    for w, p, q in zip(where.tolist(), i.tolist(), j.tolist()):
        length[w] = _match(symbols, p, q, DIRECT)
    base = own[np.maximum(np.searchsorted(own, a, side="right") - 1, 0)]
    return (length[base] + base - a)[order]


def _match(symbols: np.ndarray, i: int, j: int, t: int) -> int:
    """How many symbols from i and j are equal, t at least."""
    n, step = len(symbols), 256
    while max(i, j) + t < n:
        m = min(step, n - max(i, j) - t)
        apart = np.flatnonzero(symbols[i + t : i + t + m] != symbols[j + t : j + t + m])
        if len(apart):
            return t + int(apart[0])
        t, step = t + m, step * 2
    return t


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high] by a sparse table, of which one level is held at a time."""
    out = np.zeros(len(low), values.dtype)
    if not len(low):
        return out
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next position with a smaller value, or the length.  What stands between a position and its pointer is larger, so a pointer
    moves on to the pointer of what it names, final or not; those that need many moves are looked up in a tree of minima."""
    n = len(values)
    wide = np.append(values, -1)
    out = np.arange(1, n + 1)
    open_ = np.flatnonzero(wide[out] > values)
    for _ in range(6):
        if not len(open_):
            return out
        out[open_] = out[out[open_]]
        open_ = open_[wide[out[open_]] > values[open_]]
    out[open_] = _first_below(wide, out[open_], values[open_])
    return out


def _first_below(values: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first position from each at on with a value below bound; there is one, since the last value is below all."""
    tree = [values]
    while len(tree[-1]) > 1:
        low = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], np.iinfo(values.dtype).max)
        tree.append(np.minimum(low[::2], low[1::2]))
    node, level = at.copy(), np.full(len(at), -1)
    for k, low in enumerate(tree):  # up, until a node to the right holds a smaller value
        seek = np.flatnonzero(level < 0)
        here = node[seek]
        edge = here % 2 == 1 if k + 1 < len(tree) else np.ones(len(here), bool)
        caught = edge & (low[np.minimum(here, len(low) - 1)] < bound[seek])
        level[seek[caught]] = k
        missed = seek[~caught]
        node[missed] = (node[missed] + 1) >> 1
    for k in range(len(tree) - 1, 0, -1):  # down, to the first of it
        seek = np.flatnonzero(level >= k)
        left = node[seek] * 2
        node[seek] = np.where(tree[k - 1][left] < bound[seek], left, left + 1)
    return node


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of at least least words and two periods, by text, start and period.

    words: hashes of the words of some texts, the i-th of which has words[first[i]:first[i + 1]].
    """
    n, texts = len(words), len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none, none
    names, symbols = np.unique(words, return_inverse=True)
    many = len(names)
    # Later texts are smaller, so that the next smaller suffix is never beyond the end of a text.
    symbols = (texts - 1 - text) * many + symbols
    turned = (texts - 1 - text) * many + (many - 1 - symbols % many)
    begin, end = first[:-1][text], first[1:][text]
    order, rank = suffix_ranks(symbols, end)
    i = np.arange(n)
    roots = []
    for ranks in (rank, suffix_ranks(turned, end)[1]):
        j = next_smaller(ranks)
        # a root that neither goes on to the right nor to the left has one period
        more = (j < end) & (symbols[np.minimum(j, n - 1)] == symbols)
        before = (i > begin) & (symbols[np.maximum(i - 1, 0)] == symbols[j - 1])
        at = np.flatnonzero(more | before)
        roots.append(np.stack([at, j[at]]))
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    right, r_end = _near(symbols, i, j, 1, end[i] - j, least)
    left, l_end = _near(symbols, i - 1, j - 1, -1, i - begin[i], least)
    # roots that end soon on both sides are decided; for texts that have others, arrays of common prefixes say how far they reach
    far = np.isin(text[i], np.unique(text[i[~(r_end & l_end)]]))
    if far.any():
        own = np.zeros(texts, bool)
        own[text[i[far]]] = True
        kept = np.flatnonzero(own[text])
        new = np.cumsum(own[text]) - 1
        back = symbols[kept][::-1].copy()
        a, b, m = new[i[far]], new[j[far] - 1] + 1, len(kept)
        ok = j[far] < end[i[far]]
        order = new[order[own[text[order]]]]
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        reach = np.zeros(len(a), np.int64)
        reach[ok] = _reach(order, rank, common_prefixes(symbols[kept], order), a[ok], b[ok])
        right[far] = reach
        ok = i[far] > begin[i[far]]
        order, rank = suffix_ranks(back, m - new[begin[kept]][::-1])
        reach = np.zeros(len(a), np.int64)
        reach[ok] = _reach(order, rank, common_prefixes(back, order), m - a[ok], m - b[ok])
        left[far] = reach
    period = j - i
    start, length = i - left, right + left + period
    held = np.flatnonzero(length >= np.maximum(least, 2 * period))
    found = np.unique(np.stack([text[i[held]], start[held] - begin[i[held]], period[held], length[held]]), axis=1)
    return found[0], found[1], found[3], found[2]


def _near(symbols: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols from i and j on are equal in that direction, most at most; and whether they end there."""
    n = len(symbols)
    length, ended = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    open_ = np.arange(len(i))
    for t in range(most):
        a, b = i[open_] + step * t, j[open_] + step * t
        same = (t < room[open_]) & (symbols[np.clip(a, 0, n - 1)] == symbols[np.clip(b, 0, n - 1)])
        ended[open_[~same]] = True
        open_ = open_[same]
        length[open_] = t + 1
    return length, ended


def _reach(order: np.ndarray, rank: np.ndarray, common: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i and j."""
    a, b = rank[i], rank[j]
    return range_min(common, np.minimum(a, b) + 1, np.maximum(a, b))


def kept_bytes(words: kn.Words, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts): the words that are not dropped, joined by one space in each text."""
    n = len(words.data)
    size = n + 1
    step = np.zeros(size, np.int8)
    keep = np.flatnonzero(~dropped)
    if not len(keep):
        return np.zeros(0, np.uint8), np.zeros(len(words.first), np.int64)
    starts, ends = words.starts[keep], words.ends[keep]
    text = np.searchsorted(words.first, keep, side="right")
    follows = np.append(text[1:] == text[:-1], False)  # another kept word of the same text comes after
    ends = ends + follows  # with the white space behind it, of which there is some
    step[starts] += 1
    np.add.at(step, ends, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    data = words.data.copy()
    data[ends[follows] - 1] = 32
    total = np.concatenate(([0], np.cumsum(ends - starts)))
    return data[inside], total[np.searchsorted(keep, words.first)]


def _results(least: int):
    def work(texts: pa.Array) -> list[pa.Array]:
        words = kn.Words(*kn.utf8(texts), kn.NOT_SPACE)
        text, start, length, period = runs(words.hashes, words.first, least)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        delta = np.zeros(len(words) + 1, np.int64)
        at = words.first[text] + start
        np.add.at(delta, at + period, 1)
        np.add.at(delta, at + length, -1)
        body, offsets = kept_bytes(words, np.cumsum(delta[:-1]) > 0)
        lists = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
        view = body.tobytes()
        return [
            pa.array(np.diff(words.first)),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), lists),
            pa.array([view[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string()),
        ]

    return work


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns keep, n_words, runs (start, length and period by word numbers) and collapsed: the words outside of repeats, joined by one
    space.  Of a run, what lies behind its first period is a repeat."""
    return with_results(docs, text, keep, {"n_words": T.LongType(), "runs": RUNS, "collapsed": T.StringType()}, _results(least))


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the contract: in one of ten documents the words from some word on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1), lambda i: F.element_at(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int") + 1)), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: t != "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    one = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("_one", one).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_one.s")).alias("start"),
        F.col("_one.n").alias("length"),
        (-F.col("_one.p")).alias("period"),
        F.floor(1000 * F.col("_one.n") / -F.col("_one.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
