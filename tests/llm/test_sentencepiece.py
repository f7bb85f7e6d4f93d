import random

import pyarrow as pa
import pytest

from lodestone.llm import sentencepiece_codec as sp

from .conftest import frame


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def strings(n, seed):
    rnd = random.Random(seed)
    for k in range(n):
        alphabet = ["the ", "tion", "ing", "a", "b", " ", "  ", "\n", "é", "梦", "①", "\x00x", "eau", "▁"][: 4 + k % 11]
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400)))


def test_chunked_scan_equals_the_library(spark, library):
    """Cuts anywhere, in words without a space too."""
    texts = list(enumerate(strings(60, 1)))
    for size in (9, 57):
        got = {r.doc_id: r.ids for r in sp.encode(frame(spark, texts), chunk=size).collect()}
        assert got == {i: library.encode(t) for i, t in texts}


def test_products_are_associative():
    v = sp.vocabulary(sp.MODEL)
    t = sp.normalise("internationalization" * 6)
    cuts = list(range(0, len(t), 11))
    chunks = [sp.Chunk(v, t[max(0, s - 24) : s + 35], s - max(0, s - 24), s - max(0, s - 24) + len(t[s : s + 11]), s == 0, s == cuts[-1]) for s in cuts]
    m = [c.matrix() for c in chunks]
    left = m[0]
    for x in m[1:]:
        left = sp.product(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = sp.product(x, right)
    assert left[0] == right[0] == [sp.START] and abs(left[2][0, left[1].index(sp.END)] - right[2][0, right[1].index(sp.END)]) < 1e-6


def test_many_groups(spark, library):
    text = "word " * 300 + "x" * 500 + " tail"
    got = sp.encode(frame(spark, [(1, text), (1, text)]), chunk=13).collect()
    assert [r.ids for r in got] == [library.encode(text)] * 2


def test_round_trip_and_odd_rows(spark, odd, none):
    back = sp.decode(sp.encode(odd))
    assert back.columns == [*odd.columns, "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == 11 and all(r.decoded == (r.text or "") for r in rows)
    assert sp.decode(sp.encode(none)).count() == 0


def test_clashing_names(spark, library):
    docs = spark.createDataFrame([("word " * 30, 1, 2, 3), ("short", 4, 5, 6)], "text string, row long, `a.b` int, seq int")
    back = sp.decode(sp.encode(docs, chunk=20))
    assert back.columns == ["text", "row", "a.b", "seq", "ids", "decoded"]
    assert {(r["row"], r["a.b"], r["seq"]) for r in back.collect()} == {(1, 2, 3), (4, 5, 6)} and all(r["decoded"] == r["text"] for r in back.collect())


def test_memory_of_a_worker_is_bounded(monkeypatch):
    monkeypatch.setattr(sp, "OPEN_PAIRS", 4)
    v = sp.Vocabulary(sp.MODEL)
    for a in "abcdefgh":
        assert v.compatible(a, "▁x") and v.compatible(a, "q") == (v.merge(a + "q") == [a, "q"])
    assert len(v._open) <= 4


def test_lists_of_ids():
    for x in ([[1, 2], [], [3]], [[1], None, [2, 3]], [], [None], [[]]):
        column = pa.array([[9], *x], pa.list_(pa.int32())).slice(1)
        assert sp._lists(column) == [y or [] for y in x]
