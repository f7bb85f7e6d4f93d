"""Personal data: exact base patterns, widened by a skip-chain conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns, each with its test (see _email and
the functions after it); they always stay.  The field decides about further mentions: units are
e-mail-like strings (spelt-out signs too) and digit strings of LEAST_DIGITS digits or more.  Each unit is
a variable with the labels none, email, ip, card, phone.  Neighbouring units share chain potentials; units of one
document that are equal or similar (the same e-mail address in any spelling, the same last seven digits)
share skip potentials however far apart they stand, each with the next of its kind.  Sum-product message
passing runs over the loopy graph of each document; units that a base span covers are observed.  A free
unit becomes a span where a label's belief reaches ADD_AT.

Weights are learned by pseudo-likelihood gradient descent on units of at most TRAIN_DOCS whole documents,
with the base labels as teacher.  Features are dropped at random in training, so that shape and context
carry weight on their own.

Defined results.  Null and empty texts have no spans.  Very long texts are handled whole, with skip edges
over any distance.  Positions are code points, end exclusive.  Of labels that tie, the first of KINDS counts.
Rows that repeat are judged alike.  An empty table gives an empty table; without training units nothing is
added.  Columns of the input, of any name, pass through; results replace columns of their names.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as kn
from .rows import with_results
from .sqltext import column

KINDS = ("email", "ip", "card", "phone")
NONE, EMAIL, IP, CARD, PHONE = range(5)
LEAST_DIGITS = 7
TRAIN_DOCS = 1500
ADD_AT = 0.8
NEAR = 200  # characters between units that are chain neighbours
ROUNDS, DAMPING = 12, 0.5
CONTEXT = 64

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _email(text: str) -> Iterator[tuple[int, int]]:
    past, i = 0, text.find("@")
    while i >= 0:
        start = i
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, i + 1) if start < i else None
        if m:
            past = m.end()
            yield start, past
        else:
            past = max(past, i + 1)  # no match begins at or before a sign that failed
        i = text.find("@", max(i + 1, past))


def _ip(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 or not (y := x.lstrip("0")) or len(y) <= 3 and int(y) <= 255 for x in m.group().split(".")):
            yield m.span()


def _card(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phone(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end), by start and then kind."""
    found = []
    if "@" in text:
        found += [(s, EMAIL, e) for s, e in _email(text)]
    found += [(s, IP, e) for s, e in _ip(text)]
    found += [(s, CARD, e) for s, e in _card(text)]
    if "+" in text:
        found += [(s, PHONE, e) for s, e in _phone(text)]
    return sorted(found)


_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)( ?[\[({<] ?at ?[\])}>] ?| at )([A-Za-z0-9-]++(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)[A-Za-z0-9-]++)++)", re.IGNORECASE)
_AFTER_AT = re.compile(r"[^\s@]*+")
_DOT = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot ", re.IGNORECASE)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9])*+")
_WORD_BEFORE = re.compile(r"(\w+)\W*$")

_NAMES = ["bias", "at", "spelt", "address", "digits<10", "digits<14", "digits<16", "digits=16", "digits<20", "digits20+", "luhn", "plus", "paren", "dash", "dots=3", "octets", "space", "card-head", "4-4-4-4", "3-4-end"]
WIDTH = len(_NAMES) + CONTEXT


def _signs(text: str) -> Iterator[tuple[int, int]]:
    """What stands around each at sign without white space or another one; no character is looked at twice."""
    past, i = 0, text.find("@")
    while i >= 0:
        start = i
        while start > past and text[start - 1] != "@" and not text[start - 1].isspace():
            start -= 1
        past = _AFTER_AT.match(text, i + 1).end()
        yield start, past
        i = text.find("@", past)


class Unit:
    __slots__ = ("start", "end", "key", "features", "label")

    def __init__(self, start: int, end: int, key: str, features: list[int], label: int):
        self.start, self.end, self.key, self.features, self.label = start, end, key, features, label


def units(text: str, base: list[tuple[int, int, int]]) -> list[Unit]:
    """Units of a text by start; label is NONE + base kind where observed, or -1."""
    found: list[tuple[int, int, str, set[str]]] = []
    for m in _SPELT.finditer(text):
        address = f"{m[1]}@{_DOT.sub('.', m[3])}".lower()
        if "dot" in m[3].lower() or m[2].strip().lower() != "at":
            found.append((m.start(), m.end(), address, {"at", "spelt", "address"}))
    if "@" in text:
        for s, e in _signs(text):
            a = next(_email(text[s:e]), None)
            if a:
                s, e = s + a[0], s + a[1]
            found.append((s, e, text[s:e].lower(), {"at", *(("address",) if a else ())}))
    for m in _NUMBER.finditer(text):
        raw = m.group()
        d = "".join(_DIGIT.findall(raw))
        n = len(d)
        if n < LEAST_DIGITS:
            continue
        f = {"digits<10" if n < 10 else "digits<14" if n < 14 else "digits<16" if n < 16 else "digits=16" if n == 16 else "digits<20" if n < 20 else "digits20+"}
        parts = re.split(r"[^0-9]+", raw.strip("+( )"))
        if len(parts) > 2 and re.fullmatch("(19|20)[0-9][0-9]", parts[0]) and len(parts[1]) == len(parts[2]) == 2:
            continue  # a date
        f |= {name for name, on in (
            ("luhn", 13 <= n <= 19 and luhn(d)), ("plus", raw[0] == "+"), ("paren", "(" in raw), ("dash", "-" in raw), ("dots=3", raw.count(".") == 3),
            ("octets", raw.count(".") == 3 and len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)), ("space", " " in raw), ("card-head", d[0] in "3456"),
            ("4-4-4-4", [len(p) for p in parts] == [4, 4, 4, 4]), ("3-4-end", [len(p) for p in parts[-2:]] == [3, 4])) if on}
        found.append((m.start(), m.end(), f"#{d[-7:]}" if "octets" not in f else raw, f))
    out: list[Unit] = []
    past, b = -1, 0
    for s, e, key, names in sorted(found, key=lambda x: (x[0], -x[1])):
        if s < past:
            continue
        past = e
        before = _WORD_BEFORE.search(text[max(0, s - 40) : s])
        features = [0, *(_NAMES.index(n) for n in names)]
        if before:
            features.append(len(_NAMES) + zlib.crc32(before[1].lower().encode()) % CONTEXT)
        while b < len(base) and base[b][2] <= s:
            b += 1
        label, j = -1, b
        while label < 0 and j < len(base) and base[j][0] < e:
            label = base[j][1] if base[j][2] > s else -1
            j += 1
        out.append(Unit(s, e, key, features, label))
    return out


def graph(docs: list[list[Unit]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain and skip edges between units numbered over all documents."""
    chain, skip, n = [], [], 0
    for us in docs:
        last: dict[str, int] = {}
        for i, u in enumerate(us):
            if i and u.start - us[i - 1].end <= NEAR:
                chain.append((n + i - 1, n + i))
            if u.key in last:
                skip.append((n + last[u.key], n + i))
            last[u.key] = i
        n += len(us)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


class Field:
    """unary: feature weights; chain and skip: log-potentials of label pairs."""

    def __init__(self, unary: np.ndarray | None = None, chain: np.ndarray | None = None, skip: np.ndarray | None = None):
        self.unary = np.zeros((WIDTH, 5)) if unary is None else unary
        self.chain = np.zeros((5, 5)) if chain is None else chain
        self.skip = np.zeros((5, 5)) if skip is None else skip

    def beliefs(self, docs: list[list[Unit]]) -> np.ndarray:
        """Label marginals of all units by loopy message passing."""
        flat = [u for us in docs for u in us]
        local = np.array([self.unary[u.features].sum(axis=0) for u in flat]).reshape(-1, 5)
        seen = np.array([u.label for u in flat])
        at = np.flatnonzero(seen >= 0)
        local[at] = -60.0
        local[at, seen[at]] = 0.0
        chain, skip = graph(docs)
        a = np.concatenate((chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]))
        b = np.concatenate((chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]))
        e = len(chain) + len(skip)
        one = np.concatenate((np.broadcast_to(self.chain, (len(chain), 5, 5)), np.broadcast_to(self.skip, (len(skip), 5, 5))))
        pot = np.concatenate((one, one.transpose(0, 2, 1)))
        turn = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
        m = np.zeros((2 * e, 5))
        for _ in range(ROUNDS if e else 0):
            total = local.copy()
            np.add.at(total, b, m)
            x = (total[a] - m[turn])[:, :, None] + pot
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            m = DAMPING * m + (1 - DAMPING) * new
        total = local.copy()
        np.add.at(total, b, m)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(docs: list[list[Unit]], steps: int = 300, rate: float = 0.5, drop: float = 0.4, decay: float = 1e-3, seed: int = 5) -> Field:
    """Pseudo-likelihood: every label given its neighbours'."""
    flat = [u for us in docs for u in us]
    field = Field()
    if not flat:
        return field
    x = np.zeros((len(flat), WIDTH))
    for i, u in enumerate(flat):
        x[i, u.features] = 1
    y = np.maximum(np.array([u.label for u in flat]), 0)
    truth = np.eye(5)[y]
    chain, skip = graph(docs)
    rng = np.random.default_rng(seed)
    for _ in range(steps):
        kept = x * (rng.random(x.shape) > drop)
        z = kept @ field.unary
        np.add.at(z, chain[:, 1], field.chain[y[chain[:, 0]]])
        np.add.at(z, chain[:, 0], field.chain.T[y[chain[:, 1]]])
        np.add.at(z, skip[:, 1], field.skip[y[skip[:, 0]]])
        np.add.at(z, skip[:, 0], field.skip.T[y[skip[:, 1]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (truth - p / p.sum(axis=1, keepdims=True)) / len(flat)
        field.unary += rate * (kept.T @ g - decay * field.unary)
        for table, edges in ((field.chain, chain), (field.skip, skip)):
            if len(edges):
                d = truth[edges[:, 0]].T @ g[edges[:, 1]] + g[edges[:, 0]].T @ truth[edges[:, 1]]
                table += rate * (d - decay * table)
    return field


def find_all(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    docs = [units(t, b) if t else [] for t, b in zip(texts, base)]
    out = [(b, list(b)) for b in base]
    if any(docs):
        p = field.beliefs(docs)
        i = 0
        for t, us in enumerate(docs):
            for u in us:
                if u.label < 0:
                    best = 1 + int(np.argmax(p[i, 1:]))
                    if p[i, best] >= ADD_AT:
                        out[t][1].append((u.start, best, u.end))
                i += 1
            out[t][1].sort()
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_HAS = np.zeros(256, bool)
_HAS[48:58] = _HAS[ord("@")] = True


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = TRAIN_DOCS) -> Field:
    """Fit on at most max_docs documents that hold a digit or an at sign; their units, not their texts, reach the driver."""
    rows = docs.select(F.xxhash64(column(key)).alias("h"), column(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    n = rows.count()
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < min(1.0, (1.2 * max_docs + 50) / max(1, n)) * (1 << 20))
    teacher = F.udf(lambda t: pickle.dumps(units(t, base_spans(t))), T.BinaryType())
    found = sorted(some.select("h", teacher("t").alias("units")).collect(), key=lambda r: (r["h"] % (1 << 20), r["h"], r["units"]))[:max_docs]
    return fit([pickle.loads(r["units"]) for r in found])


def find(docs: DataFrame, field: Field, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with base and spans, arrays of (kind, start, end)."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("base", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(texts: pa.Array) -> list[pa.Array]:
        data, at = kn.utf8(texts)
        has = np.flatnonzero((kn.per_text(_HAS[data], at) > 0) | _spelt(texts))
        found = find_all([texts[int(t)].as_py() for t in has], shared.value)
        both: list[list] = [[[] for _ in range(len(texts))] for _ in range(2)]
        for t, pair in zip(has.tolist(), found):
            for side, spans in zip(both, pair):
                side[t] = [{"kind": KINDS[k - 1], "start": s, "end": e} for s, k, e in spans]
        return [pa.array(x, _SPAN_ARROW) for x in both]

    return with_results(docs, text, keep, {"base": _SPAN, "spans": _SPAN}, work)


def _spelt(column: pa.Array) -> np.ndarray:
    """Texts that may hold a spelt-out address: all that units() finds one in."""
    hit = pa.compute.match_substring_regex(column, r"(?i)[\[({<] ?at ?[\])}>]| at .*dot")
    return hit.fill_null(False).to_numpy(zero_copy_only=False)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs), carry=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
