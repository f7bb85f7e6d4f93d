"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

The vocabulary is a byte-fallback BPE model.  A sequence of pieces is the BPE encoding of its text
exactly if no merge crosses the border of any two neighbours, that is, if each two neighbours alone are
encoded as those two pieces.  So encoding is a best-path problem with pieces as states: a step from one
piece to the next costs nothing but is open only if the two are compatible, and path weights (piece
scores) add up in the max-plus semiring.

A document of more than CHUNK characters is cut into chunks at fixed places, in the middle of words
too.  The state at a cut is the piece that lies across it or ends at it.  Each chunk yields the matrix
of best weights from every state at its left cut to every state at its right cut; where a chunk holds a
word start, at which a piece must begin, the matrix is an outer sum of two vectors and the middle is
encoded by the library.  Matrices are multiplied associatively, GROUP chunks at a time, then over the
groups of a document; the best states at all cuts are read off backwards in the same two levels, and
each chunk then traces its own pieces.  Pieces belong to the chunk in which they begin.

Defined results.  Null and empty texts have no pieces and decode to an empty text.  Characters that are
not in the vocabulary become byte pieces.  A literal U+2581 is a space to this vocabulary and decodes as
one, and a text's own NUL characters are kept.  Very long texts are the giant documents above.  Paths can't tie, as
the encoding is the only open one.  Rows that repeat are encoded each.  An empty table gives an empty table.
Columns of the input, of any name, pass through; results replace columns of their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import with_results
from .sqltext import column
from .store import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
GROUP = 64
OPEN_PAIRS = 1 << 18  # pairs of pieces that a worker remembers
SPACE = "▁"
NEVER = -np.inf
START, END = ("", 0), ("", -1)  # states outside a document


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.lib
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._open: dict[tuple[str, str], bool] = {}  # at most OPEN_PAIRS

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if not a:
            return True
        if b[0] == SPACE and a[-1] != SPACE:
            return True
        known = self._open.get((a, b))
        if known is None:
            if len(self._open) >= OPEN_PAIRS:
                self._open.clear()
            known = self._open[a, b] = self.merge(a + b) == [a, b]
        return known

    def at(self, text: str, i: int) -> list[str]:
        """Pieces of text that begin at i; a character that isn't in the vocabulary stands alone."""
        found = [text[i : i + k] for k in range(1, min(self.longest, len(text) - i) + 1) if text[i : i + k] in self.scores]
        if text[i : i + 1] not in self.scores:
            found.append(text[i])
        return found

    def weight(self, piece: str) -> float:
        return self.scores.get(piece, -1e6)

    def out(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            ids.extend([i] if i is not None else [self.bytes[b] for b in p.encode()])
        return ids

    def words(self, text: str) -> list[int]:
        """Library encoding of normalised text that begins at a word start."""
        return self.lib.encode(text[1:].replace(SPACE, " "))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _word_start(text: str, lo: int, hi: int) -> int:
    """The first place from lo to before hi where a space follows another character, or -1."""
    i = max(lo, 1)
    while (i := text.find(SPACE, i, hi)) >= 0:
        if text[i - 1] != SPACE:
            return i
        i += 1
    return -1


def _last_word_start(text: str, lo: int, hi: int) -> int:
    i = hi
    while (i := text.rfind(SPACE, max(lo, 1), i)) >= 0:
        if text[i - 1] != SPACE:
            return i
    return -1


class Chunk:
    """text[lo:hi] of a document is the chunk; before lo and after hi there are a few characters of context."""

    def __init__(self, v: Vocabulary, text: str, lo: int, hi: int, first: bool, last: bool):
        self.v, self.text, self.lo, self.hi, self.is_first, self.is_last = v, text, lo, hi, first, last

    def _across(self, cut: int) -> list[tuple[str, int]]:
        """States at a cut: (piece, characters of it before the cut)."""
        v, t = self.v, self.text
        return [(p, cut - s) for s in range(max(0, cut - v.longest), cut) for p in v.at(t, s) if s + len(p) >= cut]

    def entries(self) -> list[tuple[str, int]]:
        return [START] if self.is_first else self._across(self.lo)

    def _walk(self, begin: dict[tuple[int, str], np.ndarray], stop: int, trace: bool = False):
        """Best weights of nodes (end, piece), from weights at some nodes, for pieces that begin before stop."""
        v, t = self.v, self.text
        best = dict(begin)
        back: dict = {}
        due: dict[int, list[str]] = {}
        for end, piece in begin:
            due.setdefault(end, []).append(piece)
        limit = stop
        for i in range(min(due, default=limit), limit):
            for a in due.get(i, ()):
                have = best[i, a]
                for b in v.at(t, i):
                    if i + len(b) > limit and limit < self.hi:
                        continue  # a piece never lies across a word start
                    if not v.compatible(a, b):
                        continue
                    node, w = (i + len(b), b), have + v.weight(b)
                    if node not in best:
                        best[node] = w
                        due.setdefault(node[0], []).append(b)
                        back[node] = (i, a)
                    else:
                        if trace and w[0] > best[node][0]:
                            back[node] = (i, a)
                        best[node] = np.maximum(best[node], w)
        return (best, back) if trace else best

    def _begin(self, states: list[tuple[str, int]]) -> dict[tuple[int, str], np.ndarray]:
        out: dict[tuple[int, str], np.ndarray] = {}
        for j, (piece, k) in enumerate(states):
            node = (self.lo if piece == "" else self.lo - k + len(piece), piece)
            w = np.full(len(states), NEVER)
            w[j] = 0.0
            out[node] = np.maximum(out[node], w) if node in out else w
        return out

    def _leaving(self, best: dict) -> dict[tuple[str, int], np.ndarray]:
        out = {}
        for (end, piece), w in best.items():
            k = self.hi - (end - len(piece))
            if end >= self.hi and (piece == "" or 1 <= k <= len(piece)):
                if self.is_last:
                    if end == self.hi:
                        out[END] = np.maximum(out[END], w) if END in out else w
                else:
                    out[piece, k] = np.maximum(out[piece, k], w) if (piece, k) in out else w
        return out

    def cuts(self) -> tuple[int, int]:
        return _word_start(self.text, self.lo, self.hi), _last_word_start(self.text, self.lo, self.hi)

    def matrix(self) -> tuple[list, list, np.ndarray]:
        """(states in, states out, best weights)."""
        into = self.entries()
        first, last = self.cuts()
        if first < 0:
            leave = self._leaving(self._walk(self._begin(into), self.hi))
            return into, list(leave), np.array(list(leave.values())).reshape(len(leave), len(into)).T
        reach = self._walk(self._begin(into), first)
        u = np.full(len(into), NEVER)
        for (end, _), w in reach.items():
            if end == first:
                u = np.maximum(u, w)
        leave = self._leaving(self._walk({(last, ""): np.zeros(1)}, self.hi))
        return into, list(leave), u[:, None] + np.array([w[0] for w in leave.values()])[None, :]

    def _path(self, begin: dict, stop: int, goal) -> list[str]:
        best, back = self._walk(begin, stop, trace=True)
        node = max((n for n in best if goal(n) and best[n][0] > NEVER), key=lambda n: best[n][0])
        out = []
        while node in back:
            out.append(node[1])
            node = back[node]
        return out[::-1]

    def trace(self, enter: tuple[str, int], leave: tuple[str, int]) -> list[int]:
        """Ids of the pieces that begin in the chunk."""
        first, last = self.cuts()

        def goal(node) -> bool:
            end, piece = node
            return end == self.hi if leave == END else (end >= self.hi and (piece, self.hi - end + len(piece)) == leave)

        begin = self._begin([enter])
        if first < 0:
            return self.v.out(self._path(begin, self.hi, goal))
        head = self._path(begin, first, lambda n: n[0] == first)
        tail = self._path({(last, ""): np.zeros(1)}, self.hi, goal)
        return self.v.out(head) + (self.v.words(self.text[first:last]) if first < last else []) + self.v.out(tail)


def product(a: tuple, b: tuple) -> tuple:
    """Max-plus product over the states that a leaves in and b enters in."""
    at = {s: i for i, s in enumerate(b[0])}
    pairs = [(j, at[s]) for j, s in enumerate(a[1]) if s in at]
    out = np.full((len(a[0]), len(b[1])), NEVER)
    for j, i in pairs:
        np.maximum(out, a[2][:, j, None] + b[2][None, i, :], out=out)
    return a[0], b[1], out


def best_states(matrices: list[tuple], enter, leave) -> list[tuple]:
    """(state in, state out) of each factor on the best path from enter to leave."""
    forward = [{enter: 0.0}]
    for into, out, m in matrices:
        w = np.array([forward[-1].get(s, NEVER) for s in into])
        reach = (w[:, None] + m).max(axis=0) if len(into) else np.full(len(out), NEVER)
        forward.append({s: x for s, x in zip(out, reach.tolist()) if x > NEVER})
    states, now = [leave], leave
    for (into, out, m), before in zip(reversed(matrices), reversed(forward[:-1])):
        j = out.index(now)
        now = max((s for s in into if s in before), key=lambda s: before[s] + m[into.index(s), j])
        states.append(now)
    states.reverse()
    return list(zip(states[:-1], states[1:]))


_CHUNKS = "row long, seq int, last boolean, lo int, hi int, body string"
_MATRIX = "row long, part int, seq int, body binary"
_STATES = "row long, part int, seq int, body binary"
_IDS = "row long, seq int, ids array<int>"


def _split(batches: Iterator[pa.RecordBatch], size: int, context: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row"), batch.column("text")):
            t = normalise(text.as_py())
            starts = list(range(0, len(t), size))
            for seq, s in enumerate(starts):
                e = min(len(t), s + size)
                a, b = max(0, s - context), min(len(t), e + context)
                yield pa.RecordBatch.from_pydict({"row": pa.array([row.as_py()], pa.int64()), "seq": pa.array([seq], pa.int32()), "last": [seq == len(starts) - 1], "lo": pa.array([s - a], pa.int32()), "hi": pa.array([e - a], pa.int32()), "body": [t[a:b]]})


def _chunk(v: Vocabulary, r: dict) -> Chunk:
    return Chunk(v, r["body"], r["lo"], r["hi"], r["seq"] == 0, r["last"])


def _table(rows: list[dict], kinds: dict) -> pa.Table:
    return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


_M = {"row": pa.int64(), "part": pa.int32(), "seq": pa.int32(), "body": pa.binary()}


def _ordered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))


def _multiply(table: pa.Table) -> pa.Table:
    rows = _ordered(table)
    total = pickle.loads(rows[0]["body"])
    for r in rows[1:]:
        total = product(total, pickle.loads(r["body"]))
    return _table([rows[0] | {"seq": -1, "body": pickle.dumps(total)}], _M)


def _choose_groups(table: pa.Table) -> pa.Table:
    rows = _ordered(table)
    found = best_states([pickle.loads(r["body"]) for r in rows], START, END)
    return _table([r | {"body": pickle.dumps(s)} for r, s in zip(rows, found)], _M)


def _choose_chunks(table: pa.Table, ends: pa.Table) -> pa.Table:
    rows = _ordered(table)
    enter, leave = pickle.loads(ends["body"][0].as_py())
    return _table([r | {"body": pickle.dumps(s)} for r, s in zip(rows, best_states([pickle.loads(r["body"]) for r in rows], enter, leave))], _M)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, carry: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs with ids, the piece ids of each text."""
    keep = [c for c in (docs.columns if carry is None else carry) if c != "ids"]
    large = F.length(column(text)) >= chunk

    def whole(texts: pa.Array) -> list[pa.Array]:
        ids = vocabulary(model).lib.encode([t or "" for t in texts.to_pylist()], num_threads=1)
        sizes = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
        return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]

    small = with_results(docs.where(~F.coalesce(large, F.lit(False))), text, keep, {"ids": T.ArrayType(T.IntegerType())}, whole)
    # columns travel under numbers, so that their names can be any
    own = [f"c{i}" for i in range(len(keep))]
    giants = docs.where(large).select(F.monotonically_increasing_id().alias("row"), column(text).alias("text"), *[column(c).alias(n) for c, n in zip(keep, own)])
    giants = materialize(giants, "giants")
    context = 2 * vocabulary(model).longest  # a piece that lies across a cut is seen whole from either side

    def matrices(batches):
        v = vocabulary(model)
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"row": pa.array([r["row"]], pa.int64()), "part": pa.array([r["seq"] // GROUP], pa.int32()), "seq": pa.array([r["seq"]], pa.int32()), "body": pa.array([pickle.dumps(_chunk(v, r).matrix())], pa.binary())})

    def trace(table: pa.Table, states: pa.Table) -> pa.Table:
        v = vocabulary(model)
        at = {(r["row"], r["seq"]): pickle.loads(r["body"]) for r in states.to_pylist()}
        out = [{"row": r["row"], "seq": r["seq"], "ids": _chunk(v, r).trace(*at[r["row"], r["seq"]])} for r in table.to_pylist()]
        return _table(out, {"row": pa.int64(), "seq": pa.int32(), "ids": pa.list_(pa.int32())})

    chunks = giants.select("row", "text").mapInArrow(lambda b: _split(b, chunk, context), _CHUNKS)
    chunks = chunks.withColumn("part", F.expr(f"seq div {GROUP}").cast("int"))
    of_chunk = materialize(chunks.drop("part").mapInArrow(matrices, _MATRIX), "matrices")
    of_group = of_chunk.groupBy("row", "part").applyInArrow(_multiply, _MATRIX)
    ends = of_group.groupBy("row").applyInArrow(_choose_groups, _STATES)
    states = of_chunk.groupBy("row", "part").cogroup(ends.groupBy("row", "part")).applyInArrow(_choose_chunks, _STATES)
    traced = chunks.groupBy("row", "part").cogroup(states.groupBy("row", "part")).applyInArrow(trace, _IDS)
    whole_ids = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))
    big = giants.select("row", *own).join(whole_ids, "row").select(*[F.col(n).alias(c) for c, n in zip(keep, own)], "ids")
    return small.unionByName(big)


def _lists(column: pa.ListArray) -> list[list[int]]:
    """Lists of ids; null is an empty one.  One conversion of all ids and slices of it, as Arrow's own takes a call for each."""
    flat = column.flatten().to_pylist() if column.flatten().null_count else column.flatten().to_numpy().tolist()
    past = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
    return [flat[a:b] for a, b in zip([0, *past[:-1]], past)]


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids."""
    keep = [c for c in encoded.columns if c != out]
    own = [f"c{i}" for i in range(len(keep))]
    rows = encoded.select(*[column(c).alias(n) for c, n in zip(keep, own)], column(ids).alias("ids"))
    schema = T.StructType([rows.schema[c] for c in own] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = vocabulary(model).lib
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = lib.decode(_lists(part.column("ids"))) if len(part) else []
                yield pa.RecordBatch.from_arrays([part.column(c) for c in own] + [pa.array(texts, pa.string())], names=[*own, "decoded"])

    found = rows.mapInArrow(run, schema)
    return found.select(*[found[n].alias(c) for n, c in zip([*own, "decoded"], [*keep, out])])


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    back = decode(encode(source, carry=["doc_id", "h"]))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))
