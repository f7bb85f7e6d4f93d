"""Exact vector search: all queries against all rows, one matrix product for each Arrow batch.  Ids may be of any type that sorts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sized import in_blocks, spread
from ..functions.text import WORD, words
from .ranking import DIGITS, META, Best, Filters, hit_schema, top_k

NUMBERS = 1 << 24  # of query vectors that are broadcast at once: 128 MB
HELD = 1 << 20  # best rows that a task keeps at most, in twice as many
CELLS = 1 << 21  # scores that are worked out at once
DIM = 384


def matrix(column: pa.Array, wide: int = 0) -> np.ndarray:
    """Rows of numbers; of packed vectors, as many numbers as wide says."""
    if pa.types.is_binary(column.type):
        return unpacked(column, wide)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of some ranges, one after the other."""
    past = np.cumsum(size)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(start - (past - size), size)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binary values, and where each value begins and the last one ends."""
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), edges.astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary values: a bit for each number, set if it isn't zero, then those that aren't, in 1, 2 or 4 bytes each."""
    on = x != 0
    bits, count = np.packbits(on, axis=1), on.sum(axis=1)
    most = int(np.abs(x).max(initial=0))
    wide = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    size = bits.shape[1] + count * wide
    past = np.cumsum(size)
    out = np.empty(size.sum(), np.uint8)
    out[(past - size)[:, None] + np.arange(bits.shape[1])] = bits
    out[_places(past - count * wide, count * wide)] = x[on].astype(f"<i{wide}").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.append(0, past).astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array, wide: int) -> np.ndarray:
    """The rows that packed() made of as many numbers as wide says."""
    out = np.zeros((len(column), wide))
    if not len(column):
        return out
    data, edges = _bytes(column)
    start, head = edges[:-1], (wide + 7) // 8
    on = np.unpackbits(data[start[:, None] + np.arange(head)], axis=1, count=wide).astype(bool)
    count = on.sum(axis=1)
    each = (np.diff(edges) - head) // np.maximum(count, 1)
    for n in (1, 2, 4):
        rows = np.flatnonzero((each == n) & (count > 0))
        if len(rows):
            own = on if len(rows) == len(column) else on & np.isin(np.arange(len(column)), rows)[:, None]
            out[own] = data[_places(start[rows] + head, count[rows] * n)].view(f"<i{n}")
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "vector", group: str | None = None, null_dates: bool = True) -> DataFrame:
    """(query_id, rank, id, score): cosine top k of queries(query_id, vector[, group][, filter]).

    With group, only rows of the query's group.  With a column filter in queries, a struct as sparse.passes() takes it, only
    rows whose authority, document_type, document_id and publication_date pass it: rows are judged before they
    are ranked.  null_dates says whether a row without a date passes a range of dates.

    A task sends its own k best of each query only.  Queries of up to NUMBERS numbers, with HELD best rows, take one scan of the
    vectors, more take one scan for each block of so many.  All vectors have one length; rows without a vector are no candidates.  The rows may be packed,
    as packed_vectors() makes them; the queries' vectors aren't.
    """
    own = [group] if group else []
    filtered = "filter" in queries.columns
    meta = META if filtered else []
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector"), *[F.col(c).alias("g") for c in own], *meta).where("vector IS NOT NULL AND id IS NOT NULL")
    schema = hit_schema(queries.schema["query_id"].dataType, rows.schema["id"].dataType)
    wide = queries.select(F.max(F.size("vector"))).first()[0] or 1
    found = None
    wanted = queries.select("query_id", "vector", *own, *(["filter"] if filtered else [])).where("vector IS NOT NULL")
    for block in in_blocks(wanted, max(1, min(NUMBERS // wide, HELD // max(1, k)))):
        q = normalised(np.array([r["vector"] for r in block], np.float64))
        names = pa.array([r["query_id"] for r in block], to_arrow_type(schema["query_id"].dataType))
        shared = vectors.sparkSession.sparkContext.broadcast((q, names, [r[group] for r in block] if group else None, [r["filter"] for r in block] if filtered else None))
        part = rows.mapInArrow(_scorer(shared, k, null_dates), schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    return top_k(found, k).select("query_id", "rank", "id", "score")


def _scorer(shared, k: int, null_dates: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, groups, filters = shared.value
        best = Best(names, k)
        judged = Filters(filters, null_dates) if filters is not None else None
        for whole in batches:
            rows = max(1, CELLS // max(1, len(names)))
            for i in range(0, len(whole), rows):
                batch = whole.slice(i, rows)
                score = np.round(normalised(matrix(batch.column("vector"), q.shape[1])) @ q.T, DIGITS)
                if groups is not None:
                    own = np.array(batch.column("g").to_pylist(), object)
                    score = np.where(own[:, None] == np.array(groups, object)[None, :], score, -np.inf)
                if judged:
                    score = np.where(judged.passes(batch), score, -np.inf)
                best.add(score, batch.column("id"))
        yield from best.batches()

    return run


ROWS = 2048  # texts that are hashed at once
BLOCK = 1 << 14  # words or pairs whose digests are worked out at once: 1 MB
SHORT = 55  # bytes that one block of MD5 takes at most
# The constants and rotations of MD5.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]


def digests(parts: list[tuple[pa.Array, np.ndarray]], between: bytes = b"_") -> np.ndarray:
    """(4, n): the MD5 of n texts, as big-endian numbers of 32 bits.  parts: words with the number of each text's word; a text is its words with
    between in between.  Texts of up to SHORT bytes are digested together, longer ones one by one."""
    data, starts, sizes = [], [], []
    for words_, at in parts:
        buffer, edges = _bytes(words_.cast(pa.binary()))
        data.append(buffer)
        starts.append(edges[:-1][at])
        sizes.append(np.diff(edges)[at])
    n = len(starts[0])
    total = sum(sizes) + len(between) * (len(parts) - 1)
    out = np.empty((4, n), np.uint64)
    short = np.flatnonzero(total <= SHORT)
    for i in range(0, len(short), BLOCK):
        rows = short[i : i + BLOCK]
        block = np.zeros((len(rows), 64), np.uint8)
        flat, past = block.reshape(-1), np.arange(len(rows)) * 64
        for k, (buffer, start, size) in enumerate(zip(data, starts, sizes)):
            for byte in between if k else b"":
                flat[past] = byte
                past = past + 1
            flat[_places(past, size[rows])] = buffer[_places(start[rows], size[rows])]
            past = past + size[rows]
        flat[past] = 0x80
        message = np.ascontiguousarray(block.view("<u4").T)
        message[14] = total[rows] * 8
        out[:, rows] = _md5(message).byteswap()
    for i in np.flatnonzero(total > SHORT):
        text = between.join(buffer[start[i] : start[i] + size[i]].tobytes() for buffer, start, size in zip(data, starts, sizes))
        out[:, i] = np.frombuffer(hashlib.md5(text).digest(), ">u4")
    return out


def _md5(message: np.ndarray) -> np.ndarray:
    """The four numbers of the MD5 of messages of one block each, a column for each message."""
    first = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(message.shape[1], x, np.uint32) for x in first)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += message[g]
        f += np.uint32(SINES[i])
        a, d, c, b = d, c, b, b + (f << np.uint32(TURNS[i]) | f >> np.uint32(32 - TURNS[i]))
    return np.stack([a, b, c, d]) + first[:, None]


def _grams(column: pa.Array, dim: int, silent: np.ndarray | int = 0) -> np.ndarray:
    """(row, component): sums of the signs of the words and pairs of neighbours of each row of lists of words.  Each different word and pair is
    hashed once.  silent: how many words at the end of a row count in pairs only."""
    n = len(column)
    size = np.asarray(pa.compute.list_value_length(column).fill_null(0), np.int64)
    row = np.repeat(np.arange(n), size)
    coded = column.flatten().dictionary_encode()
    code, many = np.asarray(coded.indices, np.int64), len(coded.dictionary)
    side = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[side] * many + code[side + 1], return_inverse=True)
    heard = np.arange(len(row)) < (np.cumsum(size) - silent)[row]
    sums = np.zeros(n * dim, np.int64)
    of_words = [(coded.dictionary, np.arange(many))]
    of_pairs = [(coded.dictionary, pairs // max(1, many)), (coded.dictionary, pairs % max(1, many))]
    for parts, rows, gram in ((of_words, row[heard], code[heard]), (of_pairs, row[side], pair)):
        if len(gram):
            found = digests(parts)
            at = np.zeros(found.shape[1], np.uint64)
            for x in found:
                at = ((at << np.uint64(32)) + x) % np.uint64(dim)
            sign = (found[1] & np.uint64(1)).astype(np.int64) * 2 - 1
            sums += np.bincount(rows * dim + at.astype(np.int64)[gram], weights=sign[gram], minlength=n * dim).astype(np.int64)
    return sums.reshape(n, dim)


def _entries(sums: np.ndarray) -> list[pa.Array]:
    """idx and value of the components that aren't zero, each row divided by its length."""
    rows, idx = np.nonzero(sums)
    value = sums[rows, idx] / np.sqrt((sums**2).sum(axis=1))[rows]
    offsets = pa.array(np.searchsorted(rows, np.arange(len(sums) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (idx.astype(np.int32), value)]


ENTRIES = [T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))]
PACKED = [T.StructField("vector", T.BinaryType())]


def _hashed(df: DataFrame, id_: str, text: Column, dim: int, fields: list[T.StructField] = ENTRIES, made: Callable[[np.ndarray], list[pa.Array]] = _entries, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, fields, the columns keep), a row for each row: what made() gives of the sums of the hashing embedding, as a rule its entries by index.
    One pass, nothing is shuffled but a table of fewer splits than cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for i in range(0, len(every), ROWS):
                batch = every.slice(i, ROWS)
                cells = [batch.column("id"), *made(_grams(batch.column("w"), dim)), *[batch.column(c) for c in keep]]
                yield pa.RecordBatch.from_arrays(cells, names=["id", *[f.name for f in fields], *keep])

    rows = spread(df.select(F.col(id_).alias("id"), text.alias("text"), *keep)).select("id", words(F.col("text")).alias("w"), *keep)
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *fields, *[rows.schema[c] for c in keep]]))


def hashed_vectors(df: DataFrame, id_: str, text: Column, dim: int = DIM) -> DataFrame:
    """(id, vector): the hashing embedding as search() takes it, a row for each row.  A text without words has the zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            row = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(batch.column("idx")).fill_null(0)))
            out = np.zeros((n, dim))
            out[row, np.asarray(batch.column("idx").flatten())] = np.asarray(batch.column("value").flatten())
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["id", "vector"])

    entries = _hashed(df, id_, text, dim)
    return entries.mapInArrow(run, T.StructType([entries.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def packed_vectors(df: DataFrame, id_: str, text: Column, keep: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """(id, vector, the columns keep): the hashing embedding as packed() makes it, which search() takes too.  A text of 64 words has some 110
    numbers of 384 that aren't zero.  They are whole numbers, before the vector gets length one, which a search gives it."""
    return _hashed(df, id_, text, dim, PACKED, lambda sums: [packed(sums)], keep or [])


def first_word(text: Column) -> Column:
    """The first of words(), empty if there is none."""
    return F.regexp_extract(F.lower(text), WORD, 0)


def headed_vectors(vectors: DataFrame, head: Column, lead: Column, keep: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """packed_vectors() of texts with a line head before them, from those of the texts and their first words: the header's words and pairs, and the
    pair of its last word and the text's first one, are added to whole numbers that are sums over words and pairs, so texts aren't hashed again.
    head ends in a character that isn't of a word; where it is null the vector is zero, as that of a null text."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for i in range(0, len(every), ROWS):
                batch = every.slice(i, ROWS)
                sums = _grams(batch.column("w"), dim, np.asarray(batch.column("silent"), np.int64)) + matrix(batch.column("vector"), dim).astype(np.int64)
                sums[np.asarray(batch.column("w").is_null())] = 0
                yield pa.RecordBatch.from_arrays([batch.column("id"), packed(sums), *[batch.column(c) for c in keep]], names=["id", "vector", *keep])

    some = F.coalesce(lead, F.lit("")) != ""
    w = F.concat(words(head), F.when(some, F.array(lead)).otherwise(F.array().cast("array<string>")))
    rows = vectors.select("id", "vector", w.alias("w"), some.cast("int").alias("silent"), *keep)
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *PACKED, *[rows.schema[c] for c in keep]]))


def hashed_features(df: DataFrame, id_: str, text: Column, dim: int = DIM) -> DataFrame:
    """(id, idx, value): sparse hashing embedding of words and neighbour pairs, of length one.

    The index is the 128-bit MD5 modulo dim, the sign is bit 64.
    """
    entries = _hashed(df, id_, text, dim).select("id", F.explode(F.arrays_zip("idx", "value")).alias("e"))
    return entries.select("id", "e.idx", "e.value")
