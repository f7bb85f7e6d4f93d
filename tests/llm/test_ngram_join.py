import re

import pytest

from lodestone.llm import ngram_join as ngram_join_module
from lodestone.llm.ngram_join import ngram_join

from .conftest import frame, near_copies

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, num, den):
    sets = {i: shingles(t, n) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_brute_force(spark):
    texts = near_copies(150, 5, edits=4) + [(500, "one two"), (501, "ONE two"), (502, "two one"), (503, "one"), (504, ""), (505, None)]
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts), n=n, num=num, den=den).collect()}
        assert got == brute(texts, n, num, den)


def test_long_lists_lose_no_link(spark):
    """More near copies of one text than fit a chunk: their lists are joined in parts and by component."""
    texts = [(i, t) for i, t in near_copies(400, 9, length=120, edits=2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts)).collect()}
    assert got == brute(texts, 3, 90, 100)


def test_long_lists_of_different_components(spark):
    """Families that share a frequent shingle in their prefixes: sizes at and around the edges of the classes."""
    import random

    rnd = random.Random(12)
    texts = []
    for family in range(30):
        size = rnd.choice([9, 10, 11, 12, 18, 20, 22])
        base = [f"f{family}w{i}" for i in range(size - 6)] + "shared words that all have".split()
        rnd.shuffle(base)
        tail = "shared words that all have".split()
        for copy in range(5):
            words = [w for w in base if w not in tail][: size - rnd.randint(5, 6)] + tail + ([f"x{family}"] if copy == 4 else [])
            texts.append((family * 10 + copy, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts), num=60).collect()}
    assert got == brute(texts, 3, 60, 100)


def links(texts, n, num, den):
    """Pairs of rows that link, for each component."""
    sets, of, out = {i: shingles(t, n) for i, t in texts}, brute(texts, n, num, den), {}
    for a in sets:
        out.setdefault(of[a][1], 0)
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                out[of[a][1]] += den * both >= num * (len(sets[a]) + len(sets[b]) - both)
    return out


@pytest.mark.parametrize("tile", [16, ngram_join_module.TILE_SETS])
def test_links_inside_components_are_counted(spark, monkeypatch, tile):
    """All of them: of copies, of lists joined in chunks, and of components that fill several tiles."""
    monkeypatch.setattr(ngram_join_module, "TILE_SETS", tile)
    texts = near_copies(300, 9, length=120, edits=2) + [(900, "one two"), (901, "ONE two"), (902, "one two"), (903, ""), (904, None)]
    got = {r.component_id: r.n_links for r in ngram_join(frame(spark, texts)).collect()}
    assert got == links(texts, 3, 90, 100)


def test_several_levels_and_text_ids(spark):
    texts = near_copies(150, 5, edits=4) + [(500, "one two"), (501, "ONE two"), (505, None)]
    want = brute(texts, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts), fan=4, range_bytes=1000).collect()}
    assert got == want
    name = lambda i: f"n{i:04d}"
    docs = spark.createDataFrame([(name(i), t) for i, t in texts], "id string, text string")
    got = {r["id"]: (r.n_shingles, r.component_id) for r in ngram_join(docs, key="id").collect()}
    assert got == {name(i): (n, name(c)) for i, (n, c) in want.items()}


def test_odd_rows(odd):
    got = ngram_join(odd).collect()
    assert len(got) == 11
    rows = {r.doc_id: r for r in got}
    assert rows[1].n_shingles == 0 and [rows[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert rows[5].component_id == 4 and rows[7].component_id == 6 and rows[None].component_id is None and rows[8].component_id == 8


def test_empty_table(none):
    assert ngram_join(none).count() == 0
