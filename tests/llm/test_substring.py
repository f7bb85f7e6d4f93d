import random
import re

import numpy as np

from lodestone.llm import blocks as bl
from lodestone.llm.substring import recompress, substring_dedup

from .conftest import WORDS, frame, near_copies


def brute(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_against_brute_force(spark):
    texts = near_copies(200, 7, length=40, edits=6) + [(900, "ba " * 50), (901, "ba " * 13), (902, "ba " * 12), (903, "x " + "ba " * 20 + "y"), (904, None), (905, "")]
    import random

    rnd = random.Random(2)
    texts += [(1000 + i, "  \n".join(rnd.choice(WORDS[:2]) for _ in range(60))) for i in range(60)]  # few words: runs and chance repeats
    want = brute(texts)
    for layout in ({}, {"fan": 4, "range_bytes": 2000}):  # one level of the exchange, and several
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, texts), **layout).collect()}
        assert not [i for i in want if got[i] != want[i]]


def test_text_ids_and_one_hot_id(spark):
    """Ids in the order of their names; rows of one id don't remove each other's words."""
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("b", passage + " one"), ("a", passage + " two"), ("b", "three " + passage), (None, passage)], "id string, text string")
    got = sorted((str(r["id"]), r.n_removed) for r in substring_dedup(docs, key="id").collect())
    assert got == [("None", 20), ("a", 0), ("b", 20), ("b", 20)]
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "concat('text ', id) AS text")
    block = bl.dealt(hot.selectExpr("doc_id AS key", "text"), 40).groupBy("block").count()
    assert block.agg({"count": "max"}).first()[0] < 200


def test_equal_substrings_get_equal_interior_symbols():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        span = rnd.integers(0, 2**63, 40).astype(np.uint64)
        names = []
        for _ in range(2):
            left = rnd.integers(0, 2**63, rnd.integers(0, 9)).astype(np.uint64)
            right = rnd.integers(0, 2**63, rnd.integers(0, 9)).astype(np.uint64)
            name, start = recompress(np.concatenate((left, span, right)), np.array([0, len(left) + 40 + len(right)]))
            start = start - len(left)
            names.append({(int(s), int(n)) for s, n in zip(start, name) if 3 <= s and s + 4 <= 37})
        assert names[0] == names[1]


def test_spans_after_their_own_first_word(spark):
    """A window that starts on the last word of a run: 'x x w2 ... w13' against 'y x w2 ... w13'."""
    rnd = random.Random(11)
    texts = []
    for i in range(400):
        span = [f"w{rnd.randrange(10**6)}" for _ in range(13)]
        pair = [[span[0]] * rnd.randint(1, 3) + span + [f"b{i}"], [f"c{i}"] + span + [span[-1]] * rnd.randint(0, 2) + [f"d{i}"]]
        rnd.shuffle(pair)
        texts += [(2 * i + k, " ".join(t)) for k, t in enumerate(pair)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, texts)).collect()}
    want = brute(texts)
    assert not [i for i in want if got[i] != want[i]]


def test_odd_rows(odd):
    got = substring_dedup(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == 0 and by[6].n_words == 40_000
    assert by[7].n_removed == 40_000 and by[7].kept_text == "end"
    assert by[1].n_words == 0 and by[1].kept_text == "" and by[4].kept_text == "Alpha beta gamma delta"


def test_empty_table(none):
    assert substring_dedup(none).count() == 0
