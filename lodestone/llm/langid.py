"""Language identification with interpolated Kneser-Ney character models.

Text is normalised to lower-case letters with one space between words; every letter of the training
texts has its own class (MOST_LETTERS at most), and all other letters share one.  Each language has a character model of order ORDER with absolute
discounting (one discount for each order, n1 / (n1 + 2 n2)) and continuation counts below the highest
order.  TOGETHER languages share one sorted hash array for each order: a row holds each of these languages'
log-probability of that n-gram, already interpolated, and a second array holds the back-off weights of
contexts, so scoring is a binary search for each character, with shorter n-grams only where the longer
one is in none of these languages.  So the arrays grow in proportion to the languages, and a model
of more than MODEL_BYTES isn't broadcast but refused.

A text gets the language of the lowest cross-entropy per character.  Rejection is calibrated on
training texts that the counts leave out: their 99.9th percentile of cross-entropy stands for text, the
median of the same texts with their letters shuffled stands for noise, and a text of REJECT_LETTERS
letters or more is rejected from REJECT_AT of the way from one to the other on.  A text without letters
always is.

Training reads at most TRAIN_DOCS texts of each language (those with the smallest hash of the id, so the
choice depends on ids alone) and goes on until TRAIN_BYTES are reached: a classifier fit on a bounded sample
of whole texts, the last of which may pass the bound.  Scoring reads every whole text.

Defined results.  Null text and text without a letter: ``und`` with score 0 and rejected.  Very long texts
are read whole, piece by piece.  Ties go to the language that sorts first.  Rows that repeat are judged alike, and
as training rows count once.  Without any training text every language is ``und``.  An empty table gives an empty
table.  Columns of the input, of any name, pass through; results replace columns of their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as kn
from .rows import with_results
from .sqltext import column

ORDER = 4
TRAIN_DOCS = 600
TRAIN_BYTES = 2_000_000  # of each language
TOGETHER = 8  # languages of a hash array
MODEL_BYTES = 1 << 30
CALIBRATION_PART = 5  # one of so many training texts calibrates
REJECT_LETTERS, REJECT_AT = 20, 0.6
LAST_LETTER = 0x323AF  # no Unicode letter has a larger code point
ALPHABET = 62  # letters that the uniform distribution counts at least; class 0 is the space, the last one any other letter
BITS = 16  # ORDER classes fill 64 bits
MOST_LETTERS = (1 << BITS) - 2
CONTEXT = (1 << BITS * (ORDER - 1)) - 1  # an n-gram without its last class; the shift keeps the sign


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(LAST_LETTER + 2, np.uint32)
    for c in range(LAST_LETTER + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: bytes) -> np.ndarray:
    """Lower-case letters of UTF-8 bytes, with 0 for each run of others."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[np.minimum(points, LAST_LETTER + 1)]
    gap = low == 0
    stay = ~gap
    if len(gap):
        stay[1:] |= gap[1:] & ~gap[:-1]
        stay[0] = True
    return low[stay]


def _grams(classes: np.ndarray) -> np.ndarray:
    n = max(0, len(classes) - ORDER + 1)
    g = np.zeros(n, np.int64)
    for j in range(ORDER):
        g <<= BITS
        g |= classes[j : j + n]
    return g


class Part:
    """Sorted hash arrays of a few languages, over an alphabet of so many symbols."""

    def __init__(self, languages: list[str], counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], symbols: int):
        self.languages = languages
        n = len(languages)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.back_keys: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.unseen = np.float32(np.log(1.0 / symbols))
        lower = np.full((symbols, n), 1.0 / symbols)  # order 0: uniform
        lower_keys = np.zeros(0, np.int64)
        for order in range(1, ORDER + 1):
            tables = [counts[g][order] for g in languages]
            keys = np.unique(np.concatenate([k for k, _ in tables] or [np.zeros(0, np.int64)]))
            contexts = np.unique(keys >> BITS & CONTEXT)
            p = np.zeros((len(keys), n))
            weight = np.ones((len(contexts), n))
            for i, (k, c) in enumerate(tables):
                c = c.astype(float)
                once, twice = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
                discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
                at = np.searchsorted(contexts, k >> BITS & CONTEXT)
                total = np.bincount(at, weights=c, minlength=len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                weight[:, i] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                p[np.searchsorted(keys, k), i] = (c - discount) / total[at]
            shorter = keys & ((1 << (BITS * (order - 1))) - 1)
            base = lower[keys] if order == 1 else self._interpolated(lower_keys, lower, shorter, order - 1)
            p += weight[np.searchsorted(contexts, keys >> BITS & CONTEXT)] * base
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.back_keys.append(contexts)
            self.back.append(np.log(weight).astype(np.float32))
            lower, lower_keys = p, keys

    def nbytes(self) -> int:
        return sum(x.nbytes for field in (self.keys, self.logp, self.back_keys, self.back) for x in field)

    def _interpolated(self, keys: np.ndarray, p: np.ndarray, wanted: np.ndarray, order: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = p[at].copy()
        miss = keys[at] != wanted
        if miss.any():
            out[miss] = np.exp(self._score_missing(wanted[miss], order))
        return out

    def _score_missing(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities of n-grams that are in no language."""
        if order == 0:
            return np.full((len(grams), len(self.languages)), self.unseen)
        context, shorter = grams >> BITS & CONTEXT, grams & ((1 << (BITS * (order - 1))) - 1)
        out = self.look(shorter, order - 1) if order > 1 else np.full((len(grams), len(self.languages)), self.unseen)
        keys = self.back_keys[order - 1]
        at = np.minimum(np.searchsorted(keys, context), max(0, len(keys) - 1))
        found = keys[at] == context if len(keys) else np.zeros(len(grams), bool)
        out[found] += self.back[order - 1][at[found]]
        return out

    def look(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities of n-grams, a column for each language."""
        keys = self.keys[order - 1]
        if not len(keys):
            return self._score_missing(grams, order)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            out[miss] = self._score_missing(grams[miss], order)
        return out


class Model:
    """The models of all languages, in parts of TOGETHER languages."""

    def __init__(self, languages: list[str], texts: dict[str, list[bytes]], calibration: dict[str, list[bytes]], together: int | None = None):
        self.languages = languages
        seen = {g: [letters(t) for t in texts[g]] for g in languages}
        every = np.concatenate([x for g in languages for x in seen[g]] or [np.zeros(0, np.uint32)])
        chars, counts = np.unique(every[every > 0], return_counts=True)
        self.chars = np.sort(chars[np.argsort(-counts, kind="stable")[:MOST_LETTERS]])
        self.other = max(ALPHABET, len(self.chars)) + 1
        grams = {g: self._counts(seen[g]) for g in languages}
        together = together or TOGETHER
        # languages with many n-grams in common share a part where they sort side by side by their script
        script = {g: int(np.median(x)) if len(x := np.concatenate(seen[g] or [np.zeros(0, np.uint32)])) else 0 for g in languages}
        order = sorted(languages, key=lambda g: (script[g] >> 7, g))
        groups = [order[i : i + together] for i in range(0, len(order), together)] or [[]]
        self.parts = [Part(x, grams, self.other + 1) for x in groups]
        self.columns = np.array([languages.index(g) for x in groups for g in x], np.int64)
        self._calibrate(calibration)

    def nbytes(self) -> int:
        return sum(p.nbytes() for p in self.parts)

    def _counts(self, texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order; below it, in how many longer n-grams each one ends."""
        top = [self.codes(np.concatenate((np.zeros(ORDER - 1, np.uint32), x)))[1] for x in texts]
        k, c = np.unique(np.concatenate(top or [np.zeros(0, np.int64)]), return_counts=True)
        out = {ORDER: (k, c)}
        for order in range(ORDER - 1, 0, -1):
            k, c = np.unique(k & ((1 << (BITS * order)) - 1), return_counts=True)
            out[order] = (k, c)
        return out

    def classes(self, x: np.ndarray) -> np.ndarray:
        """Classes of lower-case letters."""
        if not len(self.chars):
            return np.where(x == 0, 0, self.other).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.chars, x), len(self.chars) - 1)
        return np.where(x == 0, 0, np.where(self.chars[at] == x, at + 1, self.other)).astype(np.uint16)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of characters, and the ORDER-gram that ends at each from the ORDER-th on."""
        c = self.classes(x)
        return c, _grams(c)

    def table(self) -> np.ndarray:
        """The class of every code point."""
        if not hasattr(self, "_table"):
            self._table = self.classes(_letters())
        return self._table

    def look(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams, a column for each language."""
        out = np.empty((len(grams), len(self.languages)), np.float32)
        out[:, self.columns] = np.concatenate([p.look(grams) for p in self.parts], axis=1)
        return out

    def sums(self, grams: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Sums of log-probabilities over ranges of n-grams, one part of the languages at a time."""
        out = np.empty((len(first), len(self.languages)))
        column = 0
        for part in self.parts:
            n = len(part.languages)
            total = np.concatenate((np.zeros((1, n)), np.cumsum(part.look(grams), axis=0, dtype=np.float64)))
            out[:, self.columns[column : column + n]] = total[past] - total[first]
            column += n
        return out

    def entropy(self, text: bytes) -> tuple[int, np.ndarray]:
        """Letters of a text, and each language's cross-entropy per character (nats)."""
        total, chars, n = np.zeros(len(self.languages)), 0, 0
        before = np.zeros(ORDER - 1, np.uint32)
        for piece in _pieces(text):
            x = letters(piece)
            n += int(np.count_nonzero(x))
            x = np.concatenate((before, x))
            _, g = self.codes(x)
            total -= self.sums(g, np.array([0]), np.array([len(g)]))[0]
            chars += len(g)
            before = x[len(x) - ORDER + 1 :]
        return n, total / max(1, chars)

    def _calibrate(self, texts: dict[str, list[bytes]]) -> None:
        self.limit: dict[str, float] = {}
        rng = np.random.default_rng(7)
        for i, g in enumerate(self.languages):
            own, noise = [], []
            for t in texts[g]:
                x = letters(t)
                if np.count_nonzero(x) >= REJECT_LETTERS:
                    own.append(self._mean(x)[i])
                    noise.append(self._mean(rng.permutation(x)).min())
            if own:
                own.sort()
                top = own[min(len(own) - 1, int(0.999 * len(own)))]
                self.limit[g] = top + REJECT_AT * max(0.0, float(np.median(noise)) - top)

    def _mean(self, x: np.ndarray) -> np.ndarray:
        _, g = self.codes(np.concatenate((np.zeros(ORDER - 1, np.uint32), x)))
        return -self.sums(g, np.array([0]), np.array([len(g)]))[0] / len(g)

    def predict(self, text: bytes) -> tuple[str, float, bool, float]:
        """Language, score (posterior for a text of up to 50 characters' evidence), rejected, cross-entropy."""
        n, h = self.entropy(text)
        if not n or not self.languages:
            return "und", 0.0, True, 0.0
        best = int(np.argmin(h))
        g = self.languages[best]
        z = np.exp(-min(n, 50) * (h - h[best]))
        far = n >= REJECT_LETTERS and h[best] > self.limit.get(g, np.inf)
        return g, float(1 / z.sum()), bool(far), float(h[best])


def _pieces(text: bytes, size: int = 1 << 19) -> Iterator[bytes]:
    """Parts of a text that end between characters."""
    i = 0
    while i < len(text) or not i:
        j = min(len(text), i + size)
        while j < len(text) and text[j] & 0xC0 == 0x80:
            j += 1
        yield text[i:j]
        i = max(j, 1)


def train(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on whole texts of each language among the rows that are usable: max_docs at most, and none after max_bytes are reached."""
    rows = docs.where(usable & column(lang).isNotNull() & column(text).isNotNull()).select(column(lang).alias("g"), F.xxhash64(column(key)).alias("h"), column(text).alias("t"))
    counts = {r[0]: r[1] for r in rows.groupBy("g").count().collect()}
    # half as many again as are wanted, in expectation; then the smallest hashes
    share = F.create_map(*[F.lit(x) for g, c in counts.items() for x in (g, min(1.0, (1.5 * max_docs + 50) / c))]) if counts else F.lit(0.0)
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("g")] * (1 << 20)) if counts else rows
    some = some.withColumn("x", F.xxhash64("t"))
    names = sorted(counts)
    chosen: list[tuple[str, int, int]] = []
    size, taken = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    # lengths first, so that the driver gets no text that isn't used
    for r in sorted(some.select("g", "h", "x", F.octet_length("t").alias("n")).collect(), key=lambda r: (r["h"] % (1 << 20), r["h"], r["x"])):
        g = r["g"]
        if taken[g] < max_docs and size[g] < max_bytes:
            chosen.append((g, r["h"], r["x"]))
            taken[g] += 1
            size[g] += r["n"]
    wanted = some.where(F.col("h").isin(sorted({h for _, h, _ in chosen})) & F.col("x").isin(sorted({x for _, _, x in chosen}))).dropDuplicates(["g", "h", "x"])
    bodies = {(r["g"], r["h"], r["x"]): r["t"].encode() for r in wanted.collect()} if chosen else {}
    texts: dict[str, list[bytes]] = {g: [] for g in names}
    held: dict[str, list[bytes]] = {g: [] for g in names}
    turn = dict.fromkeys(names, 0)
    for c in chosen:
        g = c[0]
        (held if turn[g] % CALIBRATION_PART == CALIBRATION_PART - 1 else texts)[g].append(bodies[c])
        turn[g] += 1
    return Model(names, texts, held)


RESULTS = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType(), "cross_entropy": T.DoubleType()}


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), rejected and cross_entropy."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    if model.nbytes() > MODEL_BYTES:
        raise ValueError(f"the models take {model.nbytes() >> 20} MB: train them on less (max_docs, max_bytes)")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_results(docs, text, keep, RESULTS, lambda texts: predict_many(shared.value, *kn.utf8(texts)))


def predict_many(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """predict() of many short texts at once; long ones go one by one."""
    rows = [model.predict(data[a:b].tobytes()) if b - a > 1 << 19 else None for a, b in zip(offsets[:-1], offsets[1:])]
    short = [i for i, r in enumerate(rows) if r is None]
    if short and model.languages:
        if len(short) < len(rows):
            data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in short])
            offsets = np.concatenate(([0], np.cumsum(np.diff(offsets)[short])))
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # texts begin at these points
        c = model.table()[np.minimum(points, LAST_LETTER + 1)]
        stay = c > 0
        stay[1:] |= stay[:-1]  # the first of a run of others
        first = at[:-1][at[:-1] < at[1:]]
        stay[first] = True
        at = np.concatenate(([0], np.cumsum(stay)))[at]
        # ORDER - 1 spaces before every text
        c = np.insert(c[stay], np.repeat(at[:-1], ORDER - 1), 0)
        sizes = np.diff(at)
        g = _grams(c)
        first = at[:-1] + (ORDER - 1) * np.arange(len(sizes))
        h = -model.sums(g, first, first + sizes) / np.maximum(sizes, 1)[:, None]
        n = kn.per_text(c > 0, np.append(first, len(c)))
        best = np.argmin(h, axis=1)
        low = h[np.arange(len(best)), best]
        score = 1 / np.exp(-np.minimum(n, 50)[:, None] * (h - low[:, None])).sum(axis=1)
        limit = np.array([model.limit.get(g, np.inf) for g in model.languages])
        far = (n >= REJECT_LETTERS) & (low > limit[best])
        for i, k, s, f, e, m in zip(short, best.tolist(), score.tolist(), far.tolist(), low.tolist(), n.tolist()):
            rows[i] = (model.languages[k], s, f, e) if m else ("und", 0.0, True, 0.0)
    rows = [r or ("und", 0.0, True, 0.0) for r in rows]
    columns = list(zip(*rows)) or [(), (), (), ()]
    return [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.float64())]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
