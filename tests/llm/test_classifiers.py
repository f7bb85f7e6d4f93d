import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kernel as kn
from lodestone.llm import langid, quality

from .conftest import frame

SYLLABLES = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ver", "keit"], "cc": ["eau", "oui", "tre", "ment"]}


def sentences(lang, n, seed):
    rnd = random.Random(f"{lang}{seed}")
    return [" ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 60))) for _ in range(n)]


def corpus(spark, seed):
    rows = [(t, g) for g in SYLLABLES for t in sentences(g, 60, seed)]
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")


def test_languages_held_out_and_noise(spark):
    docs = corpus(spark, 1)
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in got)
    rnd = random.Random(0)
    noise = frame(spark, [(i, "".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(300))) for i in range(20)])
    assert all(r.rejected for r in langid.identify(noise, model).collect())


def test_language_training_reads_whole_texts(spark):
    """The letters of the second half stand behind 100,000 characters; a text of more than the budget is whole too."""
    texts = [(i, "ka lo " * 20_000 + "mi ra " * 20_000) for i in range(3)]
    for budget in (langid.TRAIN_BYTES, 1000):
        model = langid.train(frame(spark, texts), F.lit(True), max_bytes=budget)
        assert "".join(map(chr, model.chars)) == "aiklmor"


def test_every_letter_has_its_class():
    """Languages of rare scripts beside others whose letters alone fill the 62 most frequent; words of one length."""
    rnd = random.Random(6)
    scripts = {"a": [chr(0x4E00 + i) for i in range(40_000 - 0x4E00)], "b": [chr(0x3B1 + i) for i in range(17)], "c": [chr(0x430 + i) for i in range(32)], "d": [chr(97 + i) for i in range(26)], "e": [chr(0x5D0 + i) for i in range(27)]}
    write = lambda g, n: " ".join("".join(rnd.choice(scripts[g]) for _ in range(5)) for _ in range(n)).encode()
    texts = {g: [write(g, 900 if g in "cde" else 60) for _ in range(10)] for g in scripts} | {"a": [write("a", 3000) for _ in range(10)]}
    model = langid.Model(sorted(texts), texts, {g: v[:2] for g, v in texts.items()})
    assert len(model.chars) > 20_000 and {model.predict(write(g, 12))[0] for g in "b"} == {"b"} and all(model.predict(write(g, 12))[0] == g for g in scripts)
    # classes of 1 << 15 or more set the sign of a key
    wide = np.array([[40_000, 3, 50_000, 65_000]], np.uint16)
    assert int(langid._grams(wide[0])[0] >> langid.BITS & langid.CONTEXT) == 40_000 << 32 | 3 << 16 | 50_000


def test_probabilities_sum_to_one(spark):
    texts = {g: [t.encode() for t in sentences(g, 30, 2)] for g in SYLLABLES}
    model = langid.Model(sorted(texts), texts, {g: v[:3] for g, v in texts.items()})
    symbols = np.arange(langid.ALPHABET + 2)
    for context in (0, 5, 1 << 12 | 3 << 6 | 7, 60 << 12):
        p = np.exp(model.look((context << langid.BITS) | symbols).astype(float))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def kneser_ney(texts, classes, symbols):
    """Brute force: log-probability of a class after its context, from dictionaries."""
    counts = [None, *({} for _ in range(langid.ORDER))]
    for t in texts:
        c = [0] * (langid.ORDER - 1) + classes(t)
        for i in range(langid.ORDER - 1, len(c)):
            g = tuple(c[i - langid.ORDER + 1 : i + 1])
            counts[langid.ORDER][g] = counts[langid.ORDER].get(g, 0) + 1
    for order in range(langid.ORDER - 1, 0, -1):
        for g in counts[order + 1]:
            counts[order][g[1:]] = counts[order].get(g[1:], 0) + 1
    discount = [None]
    for order in range(1, langid.ORDER + 1):
        once, twice = (sum(v == k for v in counts[order].values()) for k in (1, 2))
        discount.append(min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5)))

    def p(g):
        if not g:
            return 1 / symbols
        n = len(g)
        after = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        return max(counts[n].get(g, 0) - discount[n], 0) / total + discount[n] * len(after) / total * p(g[1:])

    return p


@pytest.mark.parametrize("together", [1, 2, 8])
def test_against_brute_force_kneser_ney(together):
    rnd = random.Random(4)
    texts = {g: [" ".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 5))) for _ in range(12)).encode() for _ in range(4)] for g, a in (("x", "abcab"), ("y", "bcdé"), ("z", "дежaд"))}
    model = langid.Model(sorted(texts), texts, {g: v[:1] for g, v in texts.items()}, together)
    classes = lambda t: model.classes(langid.letters(t)).tolist()
    brute = {g: kneser_ney(v, classes, model.other + 1) for g, v in texts.items()}
    for t in [*texts["x"][:2], *texts["y"][:1], "abé dж q".encode()]:
        c = [0] * (langid.ORDER - 1) + classes(t)
        grams = [tuple(c[i - langid.ORDER + 1 : i + 1]) for i in range(langid.ORDER - 1, len(c))]
        want = [-sum(np.log(brute[g](x)) for x in grams) / len(grams) for g in model.languages]
        assert np.allclose(model.entropy(t)[1], want, atol=1e-5)


def test_languages_of_one_script_beside_others(spark):
    """Two languages on different sets of 1,500 Han letters, beside English-like and Russian-like ones."""
    rnd = random.Random(9)
    letters = {"h1": [chr(0x4E00 + 2 * i) for i in range(1500)], "h2": [chr(0x4E01 + 2 * i) for i in range(1500)], "en": list("etaoinshrdlu"), "ru": list("оеаинтсрвл")}
    rows = [(" ".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 6))) for _ in range(40)), g) for g, a in letters.items() for _ in range(90)]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs.where(langid.held_out(F.col("doc_id"))), model).collect()
    assert len(got) > 80 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_a_large_model_is_refused(spark, odd, monkeypatch):
    model = langid.train(corpus(spark, 1), F.lit(True))
    monkeypatch.setattr(langid, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="max_bytes"):
        langid.identify(odd, model)


def test_batch_equals_single():
    texts = {g: [t.encode() for t in sentences(g, 30, 3)] for g in SYLLABLES}
    model = langid.Model(sorted(texts), texts, {g: v[:3] for g, v in texts.items()})
    mixed = [t for v in texts.values() for t in v[:4]] + [b"", b"123 !!", "Éa É".encode(), b" ka "]
    data, offsets = np.frombuffer(b"".join(mixed), np.uint8), np.cumsum([0] + [len(t) for t in mixed])
    found = langid.predict_many(model, data, offsets)
    for i, t in enumerate(mixed):
        one = model.predict(t)
        assert found[0][i].as_py() == one[0] and abs(found[1][i].as_py() - one[1]) < 1e-6 and found[2][i].as_py() == one[2]


def test_language_odd_rows(spark, odd, none):
    model = langid.train(corpus(spark, 1), F.lit(True))
    got = langid.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + list(langid.RESULTS)
    rows = got.collect()
    assert len(rows) == 11 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and all(r.rejected for r in rows if r.doc_id in (1, 2, 3))
    assert langid.identify(none, model).count() == 0
    untrained = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, untrained).collect()} == {"und"}


def test_quality_held_out(spark):
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(240):
        good = sentences("aa", 1, i)[0]
        kind = i % 4
        bad = [good, good.upper().replace(" ", "!! "), " ".join(w + "***" for w in good.split()), " ".join(w for w in good.split() for _ in range(6))][kind]
        texts.append((i, bad))
        labels.append((i, int(kind == 0), rnd.randint(0, 1)))
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks, ~quality.held_out(F.col("doc_id")))
    got = quality.score(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).join(marks, "doc_id").where("h").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_odd_rows(spark, odd, none):
    model = quality.train(odd, spark.createDataFrame([(4, 1), (5, 0), (6, 7), (None, 1), (99, 1)], "doc_id long, quality int"), F.lit(True))
    got = quality.score(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    rows = got.collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(none, model).count() == 0
    blank = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def brute_features(text):
    """Buckets of a text, one by one: words, repeats within REPEATS words, and character n-grams that no inner space parts."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out, top = [], (1 << 64) - 1

    def mix(h):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & top
        h ^= h >> 32
        h = h * 0xC2B2AE3D27D4EB4F & top
        return h ^ h >> 29

    for i, w in enumerate(words):
        out.append(mix(sum((b + 1) * pow(kn._P, j, 1 << 64) for j, b in enumerate(w.encode())) & top) >> 46)
        out += [0x51ED27 * d % quality.BUCKETS for d in range(1, quality.REPEATS + 1) if i >= d and words[i - d] == w]
    plain = re.sub(r"[\x09-\x0D]", " ", text)
    for k in quality.NGRAMS:
        for i in range(len(plain) - k + 1):
            gram = plain[i : i + k]
            if " " not in gram[1:-1]:
                h = 0x9E37 + k
                for c in gram:
                    h = h * 0x01000193 & 0xFFFFFFFF ^ ord(c)
                out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> 14)
    return out


def test_features_against_brute_force():
    texts = ["ka lo ka\tka mi  lo", "", " ", "é梦 né é梦", "ab", "🙂🙂🙂 x🙂y", "one\ntwo\x0bone", "a a a a a a"]
    data, offsets = kn.utf8(pa.array(texts))
    got = [[] for _ in texts]
    for at, bucket, edges in quality.features(data, offsets):
        for p, b in zip(at.tolist(), bucket.tolist()):
            got[int(np.searchsorted(edges, p, side="right")) - 1].append(b)
    # an empty text shares its place with the one behind it
    assert [sorted(x) for x in got if x] == [sorted(brute_features(t)) for t in texts if brute_features(t)]
    for t in texts:
        ids, counts = quality.bag(t)
        assert dict(zip(ids.tolist(), counts.tolist())) == dict(Counter(brute_features(t)))


def test_scores_against_brute_force_descent():
    """Vectors, output and bias learned step by step with plain loops; the score is the softmax of the average."""
    texts, labels = ["ka lo mi", "KA!! LO!!", "ra ra ra ra", "ka mi"], [1, 0, 0, 1]
    model = quality.fit([quality.bag(t) for t in texts], labels, epochs=2)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32).astype(float)
    out, bias, done = np.zeros((quality.DIM, 2)), np.array([0.0, np.log(0.5 / 0.5)]), 0
    for _ in range(2):
        for i in rng.permutation(4):
            found = brute_features(texts[i])
            mean = sum(vectors[b] for b in found) / len(found)
            z = mean @ out + bias
            error = np.exp(z) / np.exp(z).sum() - np.eye(2)[labels[i]]
            back, step = out @ error, quality.RATE * (1 - done / 8)
            done += 1
            out -= step * np.outer(mean, error)
            kinds = Counter(found)
            for b, n in kinds.items():
                vectors[b] -= step * min(n / len(found) * len(kinds), 4.0) / 8 * back
    for t in [*texts, "lo ra", "zz"]:
        found = brute_features(t)
        z = sum(vectors[b] for b in found) / len(found) @ out + bias
        want = np.exp(z[1]) / np.exp(z).sum()
        assert abs(model.scores(*kn.utf8(pa.array([t])))[0] - want) < 1e-4
    assert model.scores(*kn.utf8(pa.array(["ka"])))[0] > model.scores(*kn.utf8(pa.array(["ra"])))[0]
