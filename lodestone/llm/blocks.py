"""Corpus-wide key statistics without a row per word.

Texts are dealt into blocks of about BLOCK_BYTES by a hash of their id and text, so that neither an id nor a
group of copies that many rows have fills a block.  A block sends its distinct keys (hashes of n-grams,
symbols or words), sorted and delta-coded, with what it knows of each, as a row for each of FAN key ranges.
What all blocks know of a key is combined, and every block gets one small value per key back, in the order
in which it sent them: a block that works out its keys again can read the answers without any key in them.

Rows are blocks * FAN, some 61,000 a GB of text however large the corpus.  A range that would be too large
for one task is cut further: the runs of MERGE senders are merged into one, equal keys combined, and sent on as a row
for each of its parts; answers come back the same way.  So there are FAN ** levels ranges, and each
level has about as many rows as the one before it.  A key that every text has weighs one entry a block.

The exchange of texts by block is one node of the plan: passes in the same query reuse it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as kn
from ..functions.sized import broadcast_if_small
from .sqltext import column
from .store import discard, materialize

BLOCK_BYTES = 1 << 20
RANGE_BYTES = 16 << 20  # of text, for each key range at the end
FAN = MERGE = 64

REQUEST = "bucket long, sender long, n int, keys binary, extra binary"
ANSWER = "sender long, bucket long, body binary, sums array<bigint>"
_REQUEST_TYPES = {"bucket": pa.int64(), "sender": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "extra": pa.binary()}


def block_of(key: Column, text: Column, blocks: int) -> Column:
    """The block of a row; nulls don't count."""
    return F.pmod(F.xxhash64(key, text), F.lit(blocks))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(column(text)))).first()[0] or 0


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(body: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Statistic:
    """What is gathered of a key: kind is what a sender knows of it, out what it is answered."""

    kind: np.dtype
    out: np.dtype

    def combine(self, inverse: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
        """For each of n keys, what is known of all its entries."""
        raise NotImplementedError

    def answer(self, known: np.ndarray) -> np.ndarray:
        """The answer for each key, when all is known."""
        raise NotImplementedError

    def settle(self, answers: np.ndarray, known: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of entries whose key was answered to a merged run that knows so much, the answers to a sender that knew so much."""
        return answers


def _read(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unsqueeze(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]])
    return keys, np.concatenate([unsqueeze(x.as_py(), kind) for x in table["extra"]])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")  # runs that are sorted already
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return ordered[fresh], inverse


class Exchange:
    """Blocks and key ranges for so much text, and keys of so many bits."""

    def __init__(self, total_bytes: int, bits: int, fan: int = FAN, merge: int = MERGE, range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES):
        self.blocks = max(1, math.ceil(total_bytes / block_bytes))
        self.bits, self.merge = bits, merge
        self.fans = [fan]
        while math.prod(self.fans) * range_bytes < total_bytes:
            self.fans.append(min(fan, math.ceil(total_bytes / range_bytes / math.prod(self.fans))))

    def ranges(self, levels: int) -> int:
        return math.prod(self.fans[:levels])

    def _rows(self, level: int, path: int, sender: int, keys: np.ndarray, known: np.ndarray) -> pa.Table:
        """A row for each part of the range path of the level before."""
        fan, n = self.fans[level], self.ranges(level + 1)
        edges = np.array([((path * fan + i) << self.bits) // n for i in range(1, fan)], np.uint64)
        at = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
        parts = [i for i in range(fan) if at[i + 1] > at[i]]
        columns = (
            [path * fan + i for i in parts],
            [sender] * len(parts),
            [int(at[i + 1] - at[i]) for i in parts],
            [squeeze(np.diff(keys[at[i] : at[i + 1]], prepend=np.uint64(0))) for i in parts],
            [squeeze(known[at[i] : at[i + 1]]) for i in parts],
        )
        return pa.table({c: pa.array(x, kind) for (c, kind), x in zip(_REQUEST_TYPES.items(), columns)})

    def request(self, block: int, keys: np.ndarray, known: np.ndarray) -> pa.Table:
        """Sorted distinct keys of a block and what it knows of each."""
        return self._rows(0, 0, block, keys, known)

    def _merger(self, level: int, stat: Statistic) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            keys, known = _read(table, stat.kind)
            distinct, inverse = _distinct(keys)
            return self._rows(level, table["bucket"][0].as_py(), table["sender"][0].as_py() // self.merge, distinct, stat.combine(inverse, len(distinct), known))

        return merge

    def _answer(self, stat: Statistic, table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return pa.table({"sender": table["sender"], "bucket": table["bucket"], "body": table["keys"], "sums": pa.nulls(len(table), pa.list_(pa.int64()))})
        keys, own = _read(table, stat.kind)
        distinct, inverse = _distinct(keys)
        known = stat.combine(inverse, len(distinct), own)
        values = stat.settle(stat.answer(known)[inverse], known[inverse], own)
        return _bodies(table, values, [len(distinct), *(int(known[c].sum()) for c in known.dtype.names or ())])

    def _back(self, stat: Statistic, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, own = _read(table, stat.kind)
        distinct, inverse = _distinct(keys)
        known = stat.combine(inverse, len(distinct), own)
        return _bodies(table, stat.settle(answers(replies, stat.out)[inverse], known[inverse], own), None)

    def note(self, block: int, body: bytes) -> pa.Table:
        """A row that comes back to its block as it is, under a negative bucket."""
        columns = ([-1 - block], [block], [0], [body], [b""])
        return pa.table({c: pa.array(x, kind) for (c, kind), x in zip(_REQUEST_TYPES.items(), columns)})

    def run(self, asked: DataFrame, stat: Statistic) -> DataFrame:
        """The ANSWER rows of all REQUEST rows: sender is a block.  sums, in one row of each final range, are the number of
        its keys and, for a kind with fields, the sum of each.  With several levels a kind with fields has them in rows of sender -1."""
        sent = []
        for level in range(1, len(self.fans)):
            sent.append(materialize(asked, "keys"))
            asked = sent[-1].where("bucket >= 0").withColumn("group", self._group()).groupBy("bucket", "group").applyInArrow(one(self._merger(level, stat)), REQUEST)
        found = asked.groupBy("bucket").applyInArrow(one(lambda t: self._answer(stat, t)), ANSWER)
        if not sent:
            return found
        found = materialize(found, "answers")
        sums = found.where("sums IS NOT NULL").select(F.lit(-1).cast("long").alias("sender"), "bucket", F.lit(b"").alias("body"), "sums")
        for level, asked in zip(range(len(self.fans) - 1, 0, -1), reversed(sent)):
            fan = self.fans[level]
            asked = asked.where("bucket >= 0").withColumn("group", self._group())
            found = found.withColumn("parent", F.expr(f"bucket div {fan}L"))
            found = asked.groupBy("bucket", "group").cogroup(found.groupBy("parent", "sender")).applyInArrow(two(lambda t, r: self._back(stat, t, r)), ANSWER)
            found = materialize(found, "answers")
        notes = sent[0].where("bucket < 0").select("sender", "bucket", F.col("keys").alias("body"), F.lit(None).cast("array<bigint>").alias("sums"))
        discard(*sent[1:])
        found = found.union(notes)
        return found.union(sums) if stat.kind.names else found

    def _group(self) -> Column:
        return F.expr(f"sender div {self.merge}L")


def _bodies(table: pa.Table, values: np.ndarray, sums: list[int] | None) -> pa.Table:
    ends = np.cumsum(table["n"].to_numpy())
    starts = ends - table["n"].to_numpy()
    bodies = [squeeze(values[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
    return pa.table({"sender": table["sender"], "bucket": table["bucket"], "body": pa.array(bodies, pa.binary()), "sums": pa.array([sums] + [None] * (len(bodies) - 1), pa.list_(pa.int64()))})


def answers(table: pa.Table, kind) -> np.ndarray:
    """The values for a sender's sorted distinct keys."""
    if not table.num_rows:
        return np.zeros(0, kind)
    order = np.argsort(table["bucket"].to_numpy(), kind="stable")
    body = table["body"].combine_chunks()
    return np.concatenate([unsqueeze(body[int(i)].as_py(), kind) for i in order])


def one(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """work for applyInArrow by group, that leaves no memory behind."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        kn.release()
        return out

    return run


def two(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        kn.release()
        return out

    return run


def dealt(docs: DataFrame, blocks: int, *more: str) -> DataFrame:
    """(block, key, text, more) of docs(key, text, more): what every pass groups by block."""
    return docs.select(block_of(F.col("key"), F.col("text"), blocks).alias("block"), "key", "text", *more)


def only(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Texts of the blocks that another table names, where these are few enough to be broadcast."""
    wanted = blocks.select("block").distinct()
    small = broadcast_if_small(wanted)
    return texts if small is wanted else texts.join(small, "block", "left_semi")


def with_integer_ids(docs: DataFrame, key: str, text: str, work: Callable[[DataFrame], DataFrame], ids: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """work(docs(key, text, more)) with ids of any type that can be ordered.

    Integers go as they are; others are numbered in their order in a table that is written once, and the
    columns ids of the result get their names back.
    """
    rows = docs.select(column(key).alias("key"), column(text).alias("text"), *more)
    if rows.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long", "void"):
        return work(rows.withColumn("key", F.col("key").cast("long")))
    names = materialize(rows.select(F.col("key").alias("name")).where("name IS NOT NULL").distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("n")), "names")
    out = work(rows.join(names, F.col("key") == F.col("name"), "left").select(F.col("n").alias("key"), "text", *more))
    columns = out.columns
    for c in ids:
        out = out.join(names.select(F.col("n").alias(c), F.col("name").alias("_name")), c, "left").drop(c).withColumnRenamed("_name", c)
    return out.select(*columns)


__all__ = ["ANSWER", "REQUEST", "Exchange", "Statistic", "answers", "block_of", "dealt", "kn", "one", "only", "squeeze", "text_bytes", "two", "unsqueeze", "with_integer_ids"]
