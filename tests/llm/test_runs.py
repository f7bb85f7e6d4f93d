import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import runs as rr

from .conftest import frame


def plain(w, least=12):
    """(start, length, period) of all runs: every period, every stretch of equal words one period apart."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(all(w[i + x] == w[i + x + p] for x in range(n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def row(doc_id, text):
    w = planted(doc_id, words(text))
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rnd, n):
    w = [f"é{rnd.randrange(rnd.choice([1, 2, 3, 500]))}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if len(w) > 4:
            a, p = rnd.randrange(len(w)), rnd.randint(1, 9)
            w[a:a] = (w[a : a + p] * 6)[: rnd.randint(1, 40)]
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_many_texts_at_once(least):
    rnd = random.Random(least)
    for _ in range(150):
        texts = [periodic(rnd, rnd.choice([0, 1, 2, 30, 80])) for _ in range(rnd.randint(1, 6))]
        first = np.cumsum([0, *map(len, texts)])
        codes = np.array([hash(x) & (1 << 63) - 1 for t in texts for x in t], np.uint64)
        text, start, length, period = rr.runs(codes, first, least)
        got = [[(int(s), int(n), int(q)) for t, s, n, q in zip(text, start, length, period) if t == i] for i in range(len(texts))]
        assert got == [plain(t, least) for t in texts]


def test_lcp_and_next_smaller():
    rnd = random.Random(3)
    for n in (1, 2, 400):
        s = np.array((([rnd.randrange(3) for _ in range(n)]) * 3)[:n])
        order, rank = rr.suffix_ranks(s, np.full(n, n))
        suffixes = sorted(range(n), key=lambda i: s[i:].tolist())
        assert order.tolist() == suffixes and rank[order].tolist() == list(range(n))
        common = lambda i, j: next((t for t in range(n) if max(i, j) + t >= n or s[i + t] != s[j + t]), n)
        lcp = rr.common_prefixes(s, order)
        assert lcp[1:].tolist() == [common(i, j) for i, j in zip(suffixes, suffixes[1:])]
        assert rr.next_smaller(rank).tolist() == [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) for i in range(n)]
    values = np.array([rnd.randrange(99) for _ in range(300)])
    low = np.array([rnd.randrange(300) for _ in range(200)])
    high = np.array([rnd.randrange(x, 300) for x in low])
    assert rr.range_min(values, low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
    falling = np.concatenate(([5], np.arange(20_000)[::-1] + 10, [1]))  # one position that passes all others
    assert rr.next_smaller(falling)[0] == 20_001


def test_long_matches_behind_the_direct_ones():
    w = np.tile(np.arange(900), 9)
    assert [tuple(map(int, x)) for x in zip(*rr.runs(w.astype(np.uint64), np.array([0, len(w)])))] == [(0, 0, 8100, 900)]


def test_query(spark, tmp_path, odd):
    rnd = random.Random(9)
    texts = [(i, rnd.choice([" ", "  ", "\n"]).join(periodic(rnd, rnd.choice([0, 5, 60, 120])))) for i in range(250)]
    texts += [(i, "a " * 40 + "\x0b") for i in range(250, 260)] + [(300, None), (301, " \t\n"), (302, ""), (None, "b c " * 9), (None, "b c " * 9), (303, "x y"), (303, "x y")]
    frame(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, rr.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((row(i, t) for i, t in texts), key=str)
    assert sum(r[1] > 0 for r in got) > 100


def test_odd_tables(spark, odd, none):
    out = rr.find_runs(odd, ["doc_id", "kept", "a.b c"]).collect()
    assert len(out) == odd.count() and all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in out if r.doc_id in (1, 2, 3))
    assert next(r.collapsed for r in out if r.doc_id == 4) == "Alpha beta gamma delta"
    assert rr.find_runs(none, ["doc_id"]).collect() == []
