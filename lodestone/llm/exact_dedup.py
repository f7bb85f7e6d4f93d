"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows are looked at three times.  First only lengths are counted; rows of a length of their own are done.
Of the others the prefixes are hashed and (length, prefix) counted.  Whole texts are hashed only of rows
whose length and prefix may both be another row's.  Repeated lengths and repeated prefixes are handed to
the scans as bitmaps of fixed size (LENGTH_BITS, PREFIX_BITS), so that whole texts never move for a test;
a false positive costs one more hash, never a wrong result.  From about 10**8 repeated prefixes on most
bits are set, and most texts of repeated length are hashed.

The last look also numbers the rows, and its rows are written before anything is joined to them: numbers
and hashes are worked out once, whatever plan the input comes from and whichever columns are read later.

Defined results.  Null text counts as empty.  Texts are equal when identical after lower-casing A-Z.
Of equal texts the row with the largest key stays; a null key is smaller than any other.  Of rows that
repeat text and key alike, one stays.  Very long texts are hashed whole like any other.  An empty table
gives an empty table.  Columns of the input may have any name: working columns carry the prefix ``_xd_``,
and results replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from .sqltext import column, columns, lower_ascii
from .store import materialize

PREFIX_CHARS = 64
LENGTH_BITS, PREFIX_BITS = 1 << 23, 1 << 26
MOST_DROPPED = 1_000_000  # row numbers that are broadcast; more are joined by shuffle
_WORD = 32768  # bits of one bitmap of bitmap_construct_agg
RESULTS = ("keep_id", "group_size", "kept")


def _bitmap(values: DataFrame, bits: int, name: str) -> DataFrame:
    """(slot, bits) of the values of the only column, modulo bits."""
    bit = F.pmod(F.col(values.columns[0]), F.lit(bits)).cast("long")
    bit = values.select(bit.alias("bit"))
    return bit.groupBy((F.col("bit") / _WORD).cast("long").alias(f"_xd_slot_{name}")).agg(F.bitmap_construct_agg(F.col("bit") % _WORD).alias(f"_xd_bits_{name}"))


def _marked(rows: DataFrame, value: Column, bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with _xd_<name>: whether the bit of the value is set."""
    slot, field, out = f"_xd_slot_{name}", f"_xd_bits_{name}", f"_xd_{name}"
    bit = F.pmod(value, F.lit(bits)).cast("long")
    at = bit % _WORD
    byte = F.conv(F.hex(F.substring(F.col(field), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.withColumn(slot, (bit / _WORD).cast("long")).join(F.broadcast(bitmap), slot, "left")
    return joined.withColumn(out, set_).drop(slot, field)


def hashed(docs: DataFrame, key: str, text: str, carry: list[str], digest: str | None = None) -> DataFrame:
    """The carried columns, the key as _xd_key, a row number _xd_row and, of rows that may have a copy, the hash
    _xd_full; written.  digest: name of a column with the hash of every row."""
    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(*[column(c) for c in carry], column(key).alias("_xd_key"), body.alias("_xd_text"), F.octet_length(body).alias("_xd_len"))

    # Round 1: lengths that occur more than once.  The counts are partial sums before they move.
    lengths = rows.groupBy("_xd_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_xd_len")
    some = _marked(rows, F.col("_xd_len"), _bitmap(lengths, LENGTH_BITS, "length"), LENGTH_BITS, "length")

    # Round 2: of rows of those lengths, prefixes that occur more than once.
    prefix = F.xxhash64("_xd_len", lower_ascii(F.substring("_xd_text", 1, PREFIX_CHARS)))
    prefixes = some.where("_xd_length").groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p")
    at = F.when(F.col("_xd_length"), prefix)
    maybe = _marked(some, at, _bitmap(prefixes, PREFIX_BITS, "prefix"), PREFIX_BITS, "prefix")

    # Round 3: whole texts of those prefixes.
    whole = F.sha2(lower_ascii(F.col("_xd_text")), 256)
    if digest:
        maybe = maybe.withColumn("_xd_digest", whole)
        whole = F.col("_xd_digest")
    out = maybe.select(
        *[column(c) for c in carry],
        "_xd_key",
        F.monotonically_increasing_id().alias("_xd_row"),
        F.when(F.col("_xd_prefix"), whole).alias("_xd_full"),
        *([F.col("_xd_digest").alias(digest)] if digest else []),
    )
    return materialize(out, "hashed")


def _groups(rows: DataFrame) -> DataFrame:
    """(hash, row that stays, its key, size) of texts that several rows have.  Written, so that a join to it deals
    both sides anew and can split the rows of a huge group over tasks."""
    best = F.struct(F.col("_xd_key").alias("k"), F.col("_xd_row").alias("r"))
    found = rows.where("_xd_full IS NOT NULL").groupBy("_xd_full").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("_xd_size")).where("_xd_size > 1")
    return materialize(found.select("_xd_full", F.col("best.k").alias("_xd_keep"), F.col("best.r").alias("_xd_best"), "_xd_size"), "copies")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, digest: str | None = None) -> DataFrame:
    """Every input row with keep_id, group_size and kept.

    carry: the input columns that the result has (all, where None).  Only rows that may have a copy are
    joined; the others pass from the written table as they are.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*RESULTS, digest)]
    rows = hashed(docs, key, text, carry, digest)
    out = columns(*carry, *([digest] if digest else []))
    one = F.col("_xd_size").isNull()
    results = [
        F.when(one, F.col("_xd_key")).otherwise(F.col("_xd_keep")).alias("keep_id"),
        F.coalesce("_xd_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_xd_best") == F.col("_xd_row"), F.lit(True)).alias("kept"),
    ]
    alone = rows.where("_xd_full IS NULL").select(*out, F.col("_xd_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.union(rows.where("_xd_full IS NOT NULL").join(_groups(rows), "_xd_full", "left").select(*out, *results))


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs.  Hashes and row numbers move, texts don't, as
    long as at most MOST_DROPPED rows go."""
    rows = hashed(docs, key, text, list(docs.columns))
    found = rows.where("_xd_full IS NOT NULL").select("_xd_full", "_xd_row").join(_groups(rows), "_xd_full")
    dropped = materialize(found.where("_xd_row <> _xd_best").select("_xd_row"), "dropped")
    left = rows.join(broadcast_if_small(dropped, MOST_DROPPED), "_xd_row", "left_anti")
    return left.select(*columns(*docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_dedup(docs, carry=["doc_id"], digest="text_sha256")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
