"""Balanced sharding by histogram sort, in DataFrame operations only.

Rows get a 62-bit sort key: 31 bits from the text, so that equal texts lie side by side, then 31 bits
from the row, so that even one huge group of equal texts can be cut anywhere.  Splitters are found by
counting exact bytes below candidate key boundaries over all partitions; only the bins that hold a
splitter are probed again, one radix digit deeper each round, until every splitter is within the
tolerance or its bin is a single key.  Then rows are exchanged once, by sub-range, and numbered.

What reaches the driver are histogram bins: at most 2**FIRST_BITS in the first round and
splitters * 2**NEXT_BITS in each later one, whatever the number of rows.

Defined results.  Null text has no bytes and the crc32 of an empty text.  Very long texts are rows like any
other: a shard can't be cut inside one.  Rows that repeat are separate rows with their own slots.  Rows of one sort key are
ordered by id; the number in a row's key is given once, in a written table.  An empty table gives an empty table.
Columns of the input never clash: only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.sized import broadcast_if_small
from .sqltext import column
from .store import materialize

ROW_OVERHEAD = 8
KEY_BITS, FIRST_BITS, NEXT_BITS = 62, 12, 8
TOLERANCE = 0.0005  # of a shard's bytes
PARTS_PER_SHARD = 8  # sub-ranges of near equal bytes, whose splitters are found
ROWS_PER_TASK = 1_000_000  # that are sorted and numbered at once: a sub-range of more is cut by counted rows
ROWS_TOLERANCE = 0.25  # of these rows


def find_splitters(rows: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Keys below which the bytes of rows(k, size) come nearest to each of the ascending targets."""
    splitters: list[int | None] = [None] * len(targets)
    # open bins: prefix -> (bytes below it, indexes of the targets inside it)
    todo, bits = {0: (0, list(range(len(targets))))}, 0
    while todo:
        step = FIRST_BITS if not bits else min(NEXT_BITS, KEY_BITS - bits)
        inside = rows if not bits else rows.where(F.shiftright("k", KEY_BITS - bits).isin(list(todo)))
        bits += step
        counted = inside.groupBy(F.shiftright("k", KEY_BITS - bits).alias("bin")).agg(F.sum("size").alias("b")).collect()
        bins: dict[int, list[tuple[int, int]]] = {}
        for x in sorted(counted):
            bins.setdefault(x["bin"] >> step, []).append((x["bin"], x["b"]))
        deeper: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in todo.items():
            at = iter(bins.get(prefix, []))
            bin_, size = next(at, (None, 0))
            for i in wanted:
                while bin_ is not None and below + size < targets[i]:
                    below += size
                    bin_, size = next(at, (None, 0))
                if bin_ is None:
                    splitters[i] = (prefix + 1) << (KEY_BITS - bits + step)
                    continue
                under, over = targets[i] - below, below + size - targets[i]
                if min(under, over) <= tolerance or bits == KEY_BITS:
                    splitters[i] = (bin_ + (over < under)) << (KEY_BITS - bits)
                else:
                    deeper.setdefault(bin_, (below, []))[1].append(i)
        todo = deeper
    return splitters


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int = PARTS_PER_SHARD, tolerance: float = TOLERANCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, size, text_crc32, shard, slot): shards are contiguous in sort order and near equal in bytes."""
    placed = windows_of(docs, shards, key, text, parts, tolerance, rows_per_task)
    # Where each cut starts in its shard: a count for each ROWS_PER_TASK rows or so.
    starts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("k", "id")
    return (
        placed.withColumn("slot", F.row_number().over(order) - 1)
        .join(broadcast_if_small(starts), ["shard", "part"])
        .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("slot")).cast("long").alias("slot"))
    )


def windows_of(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int = PARTS_PER_SHARD, tolerance: float = TOLERANCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, size, crc, k, shard, part): rows with the window that a task sorts, of about rows_per_task rows at most."""
    body = F.coalesce(column(text), F.lit(""))
    crc = F.crc32(body.cast("binary"))
    row = F.pmod(F.xxhash64(column(key), F.monotonically_increasing_id()), F.lit(1 << 31))
    # The only pass over the texts; all later rounds read this narrow table.
    rows = materialize(
        docs.select(
            column(key).alias("id"),
            (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
            crc.alias("crc"),
            (F.shiftright(crc, 1) * F.lit(1 << 31) + row).alias("k"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / (shards * parts) for i in range(1, shards * parts)]
    splitters = find_splitters(rows, targets, tolerance * total / shards)
    for i in range(1, len(splitters)):
        splitters[i] = max(splitters[i], splitters[i - 1])

    def count_below(values):
        return F.size(F.filter(values, lambda s: s <= F.col("k")))

    outer = F.array(*[F.lit(s).cast("long") for s in splitters[parts - 1 :: parts]]) if shards > 1 else F.array().cast("array<long>")
    inner = F.array(*[F.array(*[F.lit(s).cast("long") for s in splitters[i * parts : i * parts + parts - 1]]) for i in range(shards)])
    placed = rows.withColumn("shard", count_below(outer)).withColumn("part", count_below(F.element_at(inner, F.col("shard") + 1)) if parts > 1 else F.lit(0))
    # A sub-range of many rows, such as one of empty texts, is cut into as many rows each, by the same search over counts of rows.
    counted = sorted(map(tuple, placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect()))
    wanted, below = {}, 0
    for shard, part, n in counted:
        cuts = -(-n // rows_per_task)
        wanted[shard, part] = [below + n * i / cuts for i in range(1, cuts)]
        below += n
    ends = [x for t in wanted.values() for x in t]
    cuts = max((len(t) for t in wanted.values()), default=0) + 1
    if ends:
        found = iter(find_splitters(rows.select("k", F.lit(1).cast("long").alias("size")), ends, ROWS_TOLERANCE * rows_per_task))
        inside = {at: [next(found) for _ in t] for at, t in wanted.items()}
        none = F.array().cast("array<long>")
        keys = F.array(*[F.array(*[F.lit(k).cast("long") for k in inside.get((i, j)) or ()]) if inside.get((i, j)) else none for i in range(shards) for j in range(parts)])
        cut = count_below(F.element_at(keys, F.col("shard") * parts + F.col("part") + 1))
        placed = placed.withColumn("part", F.col("part") * cuts + cut)
    return placed


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
