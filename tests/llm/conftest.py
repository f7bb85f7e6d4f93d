import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lo", "ne", "ri", "sta", "t", "ve")]


@pytest.fixture()
def odd(spark):
    """Null, empty, blank, tied, repeated, very long and null-id rows, and columns whose names clash with working ones."""
    rnd = random.Random(4)
    long = " ".join(rnd.choice(WORDS) for _ in range(40_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "Alpha beta gamma delta"), (4, "Alpha beta gamma delta"), (5, "alpha BETA gamma delta"), (None, "a null id beside a text"), (None, "a null id beside a text"), (6, long), (7, long + " end"), (8, "x")]
    rows = [(i, t, "en" if t else None, "s", 1, 0.5, [1], "k", 2, True, 3, "d", 4, 5, 6) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, items array<int>, key string, block int, kept boolean, row long, `a.b c` string, c0 int, _row int, _c1 int")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def near_copies(n, seed, length=60, edits=3):
    """Documents in families of exact and near copies, with runs of one word and shared passages."""
    rnd = random.Random(seed)
    passage = [rnd.choice(WORDS) for _ in range(30)]
    bases = [[rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(length)] for _ in range(4)]
    out = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(w))
            w[at:at] = passage[rnd.randint(0, 9) :]
        if rnd.random() < 0.3:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(WORDS)] * rnd.randint(2, 9)
        out.append((i, " ".join(w) if rnd.random() < 0.9 else " ".join(w).upper()))
    return out
