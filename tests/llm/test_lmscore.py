import math
import re
from collections import Counter

from lodestone.llm.lmscore import cross_entropy_difference

from .conftest import frame, near_copies


def brute(texts, target):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in words:
        side = 0 if i in target else 1
        one[side].update(w)
        two[side].update(zip(w, w[1:]))
    v, n = len(set(one[0]) | set(one[1])) or 1, [sum(x.values()) for x in one]
    out = {}
    for i, w in words:
        loss, mine = [0.0, 0.0], 0 if i in target else 1
        for s in (0, 1):
            # the text's own counts are left out of its side
            own, pairs, most = (Counter(w), Counter(zip(w, w[1:])), n[s] - len(w)) if s == mine else (Counter(), Counter(), n[s])
            for k, x in enumerate(w):
                base = 0.35 * ((one[s][x] - own[x]) / most if most else 1 / v) + 0.05 / v
                context = one[s][w[k - 1]] - own[w[k - 1]] if k else 0
                loss[s] -= math.log(base + 0.6 * (two[s][w[k - 1], x] - pairs[w[k - 1], x]) / context if context else base / 0.4)
        out[i] = (len(w), *(x / len(w) if w else None for x in loss))
    return out


def check(spark, texts, target, **layout):
    got = cross_entropy_difference(frame(spark, texts), spark.createDataFrame([(i,) for i in target], "doc_id long"), **layout).collect()
    assert len(got) == len(texts)
    want = brute(texts, set(target))
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_words == n
        if n:
            assert abs(r.target_loss - a) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (a - b)) < 1e-9
        else:
            assert r.score is None


def test_against_brute_force(spark):
    texts = near_copies(120, 11) + [(500, None), (501, ""), (502, "one")]
    check(spark, texts, [*range(0, 120, 3), None, 999])
    check(spark, texts, [])
    check(spark, texts, [i for i, _ in texts])
    check(spark, texts, [*range(0, 120, 3)], fan=4, range_bytes=1000)


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "one two three"), ("b", None)], "id string, text string")
    got = cross_entropy_difference(docs, docs.where("id = 'b'"), key="id")
    assert sorted((r["id"], r.n_words) for r in got.collect()) == [("a", 2), ("b", 0), ("b", 3)]


def test_a_copy_elsewhere_lowers_the_loss(spark):
    """Counts of a text itself don't vouch for it; those of a second copy do."""
    texts = [(i, " ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(60))) for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(10)]
    got = {r.doc_id: r.background_loss for r in cross_entropy_difference(frame(spark, texts), spark.createDataFrame([(59,)], "doc_id long")).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 59)) - 1


def test_odd_rows(spark, odd, none):
    got = cross_entropy_difference(odd, odd.where("doc_id = 4")).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id == 4}) == 1 and {r.score for r in got if r.doc_id in (1, 2, 3)} == {None}
    assert cross_entropy_difference(none, odd).count() == 0
