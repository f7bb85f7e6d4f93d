"""Substring dedup by recompression.

Each text is compressed in rounds that depend on a symbol and its neighbours only.  The first round
names runs: a run of one word gets the name of the word (its length stays with the span and is verified
at the end).  Each of the ROUNDS pair rounds deals all names to a left and a right side by their hash
and replaces every left-right neighbour pair by a new name, a hash of both, which is the same wherever
the pair occurs.  So equal substrings get equal interior symbols: of 13 equal words without equal
neighbours, at most 3 at either end can be named differently after two rounds.

High-level phrases (symbols from a boundary on that cover MIN_COVER words or more, 7 at most) are then
counted over the whole corpus.  A window of 13 words can only repeat where phrases inside it are shared;
windows with equal neighbours, or whose first word ends a run, are always taken.  The windows left over are verified: their own hashes
are looked up over the corpus with the smallest id that has them, and a word goes if a window that
covers it starts in a text with a smaller id.  See blocks.py for how keys travel.

Defined results.  Null text has no words and no kept text is left of it (an empty text).  Texts of fewer
than 13 words lose nothing.  Very long texts are handled whole, by one task.  A null id is larger than any
other and rows of one id never remove each other's words, so repeated rows are treated alike and ties can't
occur.  Ids may be of any type that can be ordered.  An empty table gives an empty table.  Only the id and
the text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import kernel as kn

SPAN = 13
ROUNDS, MARGIN, MIN_COVER, MAX_COVER = 2, 3, 4, 7
PHRASE_BITS, WINDOW_BITS = 40, 64
NO_ID = np.iinfo(np.int64).max
RESULT = "key long, n_words long, n_removed long, kept_text string"


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts (word positions) of the symbols of all texts."""
    n = len(hashes)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    fresh = edge[:n].copy()
    fresh[1:] |= hashes[1:] != hashes[:-1]
    start = np.flatnonzero(fresh)
    name = hashes[start]
    for level in range(rounds):
        if len(name) < 2:
            break
        left = (kn.mix(name ^ np.uint64(0x1234567 * (level + 1))) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~edge[start[1:]]
        at = np.flatnonzero(pair)
        named = name.copy()
        named[at] = kn.mix(name[at] * np.uint64(0x9FB21C651E98DF25) + name[at + 1] + np.uint64(level + 1))
        stay = np.ones(len(name), bool)
        stay[at + 1] = False
        name, start = named[stay], start[stay]
    return name, start


def phrases(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first words and ends of the shortest symbol sequences of MIN_COVER words or more in a text."""
    name, start = recompress(hashes, first)
    m = len(name)
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    end = np.append(start[1:], len(hashes)) if m else start
    key, reach, open_ = name.copy(), end.copy(), np.ones(m, bool)
    last = np.arange(m)
    for _ in range(MIN_COVER - 1):
        todo = np.flatnonzero(open_ & (reach - start < MIN_COVER))
        if not len(todo):
            break
        nxt = last[todo] + 1
        can = nxt < m
        can[can] &= ~edge[start[nxt[can]]]
        open_[todo[~can]] = False
        todo, nxt = todo[can], nxt[can]
        key[todo] = kn.mix(key[todo] * np.uint64(0x9E6C63D0876A9A47) + name[nxt])
        reach[todo], last[todo] = end[nxt], nxt
    whole = open_ & (reach - start >= MIN_COVER)
    return key[whole] >> np.uint64(64 - PHRASE_BITS), start[whole], reach[whole]


def candidates(w: kn.Words, shared: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of windows that can repeat, given which phrases are shared."""
    n = len(w)
    ok = kn.inside(w.first, SPAN, n)
    m = len(ok)
    if not m:
        return np.zeros(0, np.int64)
    h = w.hashes
    same = np.concatenate(([0], np.cumsum(h[1:] == h[:-1])))
    repeats = same[SPAN - 1 :][:m] != same[:m]
    # the last word of a run: its symbol starts before the window and can reach one word further into it
    inner = np.ones(m, bool)
    inner[w.first[w.first < m]] = False
    repeats[1:] |= (h[1:m] == h[: m - 1]) & inner[1:]
    # some shared phrase starts in the first MARGIN + 1 words and ends before the last MARGIN
    some, every = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    lo, hi = np.maximum(end - (SPAN - MARGIN), start - MARGIN)[shared], start[shared]
    fits = lo <= hi
    lo, hi = np.maximum(lo[fits], 0), hi[fits]
    np.add.at(some, lo, 1)
    np.add.at(some, hi + 1, -1)
    # no phrase that lies wholly inside the margins is unshared
    lo, hi = np.maximum(end - (SPAN - MARGIN), 0)[~shared], (start - MARGIN)[~shared]
    fits = lo <= hi
    np.add.at(every, lo[fits], 1)
    np.add.at(every, hi[fits] + 1, -1)
    able = (np.cumsum(some)[:m] > 0) & (np.cumsum(every)[:m] == 0)
    return np.flatnonzero(ok & (repeats | able))


def _settled(table: pa.Table) -> pa.Table:
    """Rows in an order of their own: the exchange delivers those of a block in any order."""
    return table.combine_chunks().sort_by([("key", "ascending"), ("text", "ascending")])


def _words(table: pa.Table) -> tuple[kn.Words, np.ndarray]:
    data, offsets = kn.utf8(table["text"])
    keys = table["key"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    return kn.Words(data, offsets, kn.NOT_SPACE), np.asarray(keys, np.int64)


def _owner(w: kn.Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, side="right") - 1


def _local(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and the smallest id of each."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(least, inverse, ids)
    return distinct, inverse, least


class _Shared(bl.Statistic):
    """Whether a phrase is in several texts; known: 1 in one text, 2 in more."""

    kind = out = np.dtype(np.uint8)

    def combine(self, inverse, n, known):
        return np.minimum(np.bincount(inverse, weights=known, minlength=n), 2).astype(np.uint8)

    def answer(self, known):
        return (known > 1).astype(np.uint8)


class _Beaten(bl.Statistic):
    """Whether a smaller id than the sender's smallest one has a window; known: the smallest id."""

    kind, out = np.dtype(np.int64), np.dtype(np.uint8)

    def combine(self, inverse, n, known):
        least = np.full(n, NO_ID, np.int64)
        np.minimum.at(least, inverse, known)
        return least

    def answer(self, known):
        return np.zeros(len(known), np.uint8)

    def settle(self, answers, known, own):
        return answers | (known < own)


class _Passes:
    def __init__(self, phrases: bl.Exchange, windows: bl.Exchange):
        self.phrases, self.windows = phrases, windows

    def ask_phrases(self, table: pa.Table) -> pa.Table:
        w, _ = _words(table)
        key, start, _ = phrases(w.hashes, w.first)
        distinct, inverse = np.unique(key, return_inverse=True)
        owner = _owner(w, start)
        low, high = np.full(len(distinct), len(w.first)), np.full(len(distinct), -1)
        np.minimum.at(low, inverse, owner)
        np.maximum.at(high, inverse, owner)
        return self.phrases.request(table["block"][0].as_py(), distinct, 1 + (low < high).astype(np.uint8))

    def ask_windows(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return self.windows.request(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        w, ids = _words(_settled(table))
        key, start, end = phrases(w.hashes, w.first)
        _, inverse = np.unique(key, return_inverse=True)
        shared = bl.answers(replies, np.uint8)[inverse].astype(bool) if len(key) else np.zeros(0, bool)
        at = candidates(w, shared, start, end)
        distinct, _, least = _local(kn.grams(w.hashes, SPAN)[at], ids[_owner(w, at)])
        block = table["block"][0].as_py()
        # the block's own note of its candidates
        note = self.windows.note(block, bl.squeeze(np.diff(at, prepend=0).astype(np.uint32)))
        return pa.concat_tables([self.windows.request(block, distinct, least), note])

    def remove(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        table = _settled(table)
        w, ids = _words(table)
        n = len(w)
        own = replies["bucket"].to_numpy() < 0
        note = replies.filter(pa.array(own))["body"][0].as_py()
        at = np.cumsum(bl.unsqueeze(note, np.uint32), dtype=np.int64)
        owner_ids = ids[_owner(w, at)]
        _, inverse, least = _local(kn.grams(w.hashes, SPAN)[at], owner_ids)
        beaten = bl.answers(replies.filter(pa.array(~own)), np.uint8).astype(bool)
        gone = np.zeros(n, bool)
        if len(at):
            start = np.zeros(n, bool)
            start[at] = beaten[inverse] | (least[inverse] < owner_ids)
            gone = kn.spread(start, SPAN, n)
        return pa.table({"key": table["key"], "n_words": pa.array(np.diff(w.first).astype(np.int64)), "n_removed": pa.array(kn.per_text(gone, w.first)), "kept_text": kept_text(w, table, ~gone)})


def kept_text(w: kn.Words, table: pa.Table, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    _, offsets = kn.utf8(table["text"])
    at = np.flatnonzero(keep)
    delta = np.zeros(len(w.data) + 2, np.int8)
    delta[w.starts[at]] += 1
    delta[w.ends[at]] -= 1
    stay = np.cumsum(delta, dtype=np.int8)[: len(w.data)].astype(bool)
    owner = _owner(w, at)
    joined = np.flatnonzero(owner[1:] == owner[:-1]) if len(at) else at
    gaps = w.ends[at[joined]]
    body = w.data.copy()
    body[gaps] = 32
    stay[gaps] = True
    total = np.concatenate(([0], np.cumsum(stay, dtype=np.int64)))
    out = total[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(out) - 1, pa.py_buffer(out.tobytes()), pa.py_buffer(body[stay].tobytes()))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", fan: int = bl.FAN, range_bytes: int = bl.RANGE_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept_text) of every row."""
    size = bl.text_bytes(docs, text)
    passes = _Passes(*(bl.Exchange(size, bits, fan, fan, range_bytes) for bits in (PHRASE_BITS, WINDOW_BITS)))

    def work(rows: DataFrame) -> DataFrame:
        texts = bl.dealt(rows, passes.phrases.blocks).groupBy("block")
        shared = passes.phrases.run(texts.applyInArrow(bl.one(passes.ask_phrases), bl.REQUEST), _Shared())
        asked = texts.cogroup(shared.groupBy("sender")).applyInArrow(bl.two(passes.ask_windows), bl.REQUEST)
        beaten = passes.windows.run(asked, _Beaten())
        return texts.cogroup(beaten.groupBy("sender")).applyInArrow(bl.two(passes.remove), RESULT)

    return bl.with_integer_ids(docs, key, text, work, ["key"]).withColumnRenamed("key", key)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT t, min(doc_id) AS m FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN least USING (t) WHERE m < doc_id),
gl AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string([w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(ps, i)], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gl USING (doc_id)
"""
