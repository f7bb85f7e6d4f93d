import re
import time

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import kernel as kn
from lodestone.llm.decontam import SPAN, Block, contamination, judge, winnow

from .conftest import frame, near_copies

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(text, items):
    w = split(text)
    hit, found = set(), set()
    for name, item in items:
        v = split(item)
        m = min(SPAN, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    texts = near_copies(80, 3)
    items = [(i, " ".join(t.split()[i : i + 10 + 3 * i])) for i, (_, t) in enumerate(texts[:14])] + [(50, "balo"), (51, "Ha-ve, ha"), (52, None), (53, "..."), (54, "ne ne ne ne ne ne ne ne ne ne ne ne ne ne")]
    texts += [(900, "balo " * 30), (901, "ne " * 40), (902, "x ha ve HA y")]
    want = {i: brute(t, items) for i, t in texts}
    for size in (1 << 24, 0):  # by broadcast, and by shuffle joins
        got = judge(contamination(frame(spark, texts), bench(spark, items), block_bytes=size)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.n_hit, r.items) == want[r.doc_id], r.doc_id
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_every_long_shared_span_shares_a_fingerprint():
    rnd = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(6)]
    for _ in range(300):
        span = rnd.choice(vocabulary, 13)
        both = [np.concatenate((rnd.choice(vocabulary, rnd.integers(0, 9)), span, rnd.choice(vocabulary, rnd.integers(0, 9)))) for _ in range(2)]
        fps = []
        for x in both:
            w = kn.Words(*kn.utf8(pa.array([" ".join(x)])), kn.ALNUM, kn.FOLD)
            fps.append(set(winnow(w.hashes, w.first, 5, 9)[1].tolist()))
        assert fps[0] & fps[1]


def words(*texts):
    return kn.Words(*kn.utf8(pa.array(texts)), kn.ALNUM, kn.FOLD)


def test_each_window_keeps_one_of_its_least_hashes():
    rnd = np.random.default_rng(5)
    for n, kinds in ((400, 2), (400, 3), (300, 40), (500, 1)):
        w = words(" ".join(f"w{x}" for x in rnd.integers(0, kinds, n)))
        at, fp = winnow(w.hashes, w.first, 5, 9)
        g = kn.grams(w.hashes, 5)
        assert (g[at] == fp).all()
        kept = set(at.tolist())
        for i in range(len(g) - 8):
            least = g[i : i + 9].min()
            assert any(p in kept and g[p] == least for p in range(i, i + 9))
        if kinds == 1:
            assert len(at) <= n // 9 + 2


def test_repeated_words_take_linear_time():
    block = Block(["1", "2"], ["la " * 2_000, "la la la"])
    w = words("la " * 20_000, "so " * 10 + "la " * 20)
    began = time.perf_counter()
    hit, pairs = block.hits(w)
    assert time.perf_counter() - began < 0.5
    assert pairs == [(0, 0), (0, 1), (1, 0), (1, 1)] and hit.sum() == 20_020


def test_an_item_in_every_text_and_a_text_with_every_item(spark):
    items = [(i, f"head{i} " + "common passage of thirteen words that each of the items has in it somewhere " + f"tail{i}") for i in range(300)]
    texts = [(1, " . ".join(t for _, t in items)), (2, items[7][1]), (3, "unrelated")]
    for size in (1 << 24, 0):
        got = {r.doc_id: r for r in contamination(frame(spark, texts), bench(spark, items), block_bytes=size).collect()}
        for i, t in texts:
            n, h, found = brute(t, items)
            assert (got[i].n_words, sum(s.past - s.first for s in got[i].hit_spans), got[i]["items"]) == (n, h, found)


@pytest.mark.parametrize("size", [1 << 24, 0])
def test_text_ids_and_names_with_dots(spark, size):
    docs = spark.createDataFrame([("a", "one two three", 1)], "id string, `a.text` string, `n.chars` long")
    got = contamination(docs, spark.createDataFrame([("x", "two three")], "item string, text string"), text="a.text", item="item", block_bytes=size).collect()
    assert got[0].asDict(True) == {"id": "a", "a.text": "one two three", "n.chars": 1, "n_words": 3, "hit_spans": [{"first": 1, "past": 3}], "items": ["x"]}


@pytest.mark.parametrize("size", [1 << 24, 0])
def test_odd_rows_and_clashes(spark, odd, size):
    items = [(1, "Alpha, beta gamma"), (2, None), (None, "null id")]
    got = judge(contamination(odd, bench(spark, items), block_bytes=size)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[4].items == ["1"] and by[4].n_hit == 3 and by[4].contaminated and by[4].key == "k"
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].contaminated
    assert by[None].items == [] and by[None].n_hit == 2


@pytest.mark.parametrize("size", [1 << 24, -1])
def test_empty_tables(spark, none, odd, size):
    assert contamination(none, bench(spark, [(1, "a b")]), block_bytes=size).count() == 0
    assert {tuple(r["items"]) for r in contamination(odd, bench(spark, []), block_bytes=size).collect()} == {()}
