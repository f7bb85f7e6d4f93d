"""Vectorised work on UTF-8 bytes in Arrow batches.

Words are maximal runs of word bytes inside one text; a byte of 0x80 or more is a word byte in every
class used here, so multi-byte characters never split.  Word hashes are polynomial over the bytes,
computed with one cumulative sum per segment and finished with a bijective mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_P, _P_INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_GRAM = U64(0xD6E8FEB86659FD93)

IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[65:91] += 32
_not_space = np.ones(256, bool)
_not_space[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x20\x09-\x0D]+
NOT_SPACE = _not_space
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[97:123] = _alnum[128:] = True
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, of folded bytes
ALNUM = _alnum

_powers: list[np.ndarray] = []
_libc = ctypes.CDLL(None)


_groups = 0
RELEASE_AFTER = 8  # groups: giving memory back costs CPU time when it is taken again


def release() -> None:
    """Give freed memory back to the system after some groups, so that a worker that waits holds little."""
    global _groups
    _groups += 1
    if _groups % RELEASE_AFTER:
        return
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES)
        _powers[:] = []
        for base in (_P, _P_INV):
            t = np.full(n, base, U64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            _powers.append(t)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(29)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of some texts: byte starts and ends, hashes, and the range of words of each text."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, fold: np.ndarray = IDENTITY, hashes: bool = True):
        body = data if fold is IDENTITY else fold[data]
        inside = word[body]
        edge = np.zeros(len(body) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(body) + 1, bool)
        before[1:] = inside
        here = np.zeros(len(body) + 1, bool)
        here[:-1] = inside
        self.data = body
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashes else None

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        i, n = 0, len(self.starts)
        while i < n:  # segments end between words, so that memory doesn't follow the length of a text
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + SLICE_BYTES)) - 1)
            lo, hi = self.starts[i], self.ends[j - 1]
            power, inverse = _power_tables(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, U64)
            np.multiply(self.data[lo:hi] + U64(1), power[: hi - lo], out=total[1:])
            np.cumsum(total, out=total)
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (total[b] - total[a]) * inverse[a]
            i = j
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j]))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours, across texts too: mask those with inside()."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _GRAM
        h += hashes[j : j + n]
    return mix(h)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for the starts of runs of k words that stay in one text; n: number of words."""
    ok = np.ones(max(0, n - k + 1), bool)
    if k > 1 and len(ok):
        cut = first[1:-1]
        delta = np.zeros(n + 2, np.int32)
        np.add.at(delta, np.maximum(cut - (k - 1), 0), 1)
        np.add.at(delta, cut, -1)
        ok &= np.cumsum(delta)[: len(ok)] == 0
    return ok


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    return _sliding(x, w, np.minimum)


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of every w neighbours."""
    return _sliding(x, w, np.maximum)


def spread(mask: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words the runs of k words that start at mask cover."""
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(mask)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + k, -1)
    return np.cumsum(delta)[:n] > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over the words of each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
