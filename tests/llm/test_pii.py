import random
import re
import time

import pyarrow as pa

from lodestone.llm import pii

from .conftest import frame

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items(), 1):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = name == "email" or (name == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (name == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits)) or (name == "phone" and 10 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns_on_random_strings():
    rnd = random.Random(3)
    parts = ["1", "2", "25", "255", "300", "4379362835490466", "007", ".", "@", "a", "b-c", "+", " ", "(", ")", "-", "_", "%", "é"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))
        assert pii.base_spans(t) == brute(t), t


def teacher():
    docs = []
    for i in range(200):
        phone, mail, card = f"+1 ({200 + i}) 555-{1000 + i}", f"user.{i}@mail{i % 7}.example.com", "4379362835490466"
        t = [f"call {phone} today, or call {phone}", f"write to {mail} soon, {mail} is read", f"pay with {card} now", f"host 10.{i}.3.4 is up", f"order 9{i:04d}123412341 shipped"][i % 5]
        docs.append(pii.units(t, pii.base_spans(t)))
    return pii.fit(docs)


def test_skip_chains_find_other_spellings():
    field = teacher()
    text = "call +1 (743) 555-3824 today. " + "word " * 200 + "again 743-555-3824 and john.doe@example.com, " + "word " * 200 + " john.doe [at] example [dot] com"
    (base, spans), (_, clean) = pii.find_all([text, "Volume 3 of 2021, page 120-125."], field)
    assert set(base) <= set(spans)
    added = {text[s:e] for s, k, e in spans if (s, k, e) not in base}
    assert added == {"743-555-3824", "john.doe [at] example [dot] com"} and clean == []


def test_training_reads_whole_texts(spark):
    """Everything to learn from stands behind 20,000 characters."""
    texts = [(i, "word " * 5000 + f"call +1 ({200 + i}) 555-{1000 + i} today") for i in range(40)]
    near = pii.fit([pii.units(t, pii.base_spans(t)) for _, t in texts])
    got = pii.train(frame(spark, texts))
    assert abs(got.unary).sum() > 0 and abs(got.unary - near.unary).max() < 0.05


def test_every_text_with_a_spelt_unit_is_judged():
    rnd = random.Random(8)
    parts = [" at ", " AT ", "(at)", " [ at ] ", " (dot) ", "(Dot)", " dot ", ".", "john", "dotty", "com", " ", "\n", "{dot}"]
    texts = ["write to john at example (dot) com", "john at dotty.com"] + ["a" + "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 9))) for _ in range(20_000)]
    hit = pii._spelt(pa.array(texts))
    assert hit[0] and hit[1] and not [t for t, h in zip(texts, hit) if pii.units(t, []) and not h]


def test_beliefs_against_all_labelings():
    """Exact marginals where the graph has no loop; close ones where it has."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(12):
        field = pii.Field(rng.normal(0, 0.8, (pii.WIDTH, 5)), rng.normal(0, 0.5, (5, 5)), rng.normal(0, 0.5, (5, 5)))
        loop = trial >= 8
        keys = ["a", "b", "a", "c", "a"] if loop else ["a", "b", "c", "d"]
        us = [pii.Unit(100 * i, 100 * i + 9, k, [0, 2 + i % 5], int(rng.integers(1, 5)) if i == 1 and trial % 2 else -1) for i, k in enumerate(keys)]
        chain, skip = pii.graph([us])
        total = np.zeros((len(us), 5))
        for labels in itertools.product(range(5), repeat=len(us)):
            if any(u.label >= 0 and u.label != x for u, x in zip(us, labels)):
                continue
            score = sum(field.unary[u.features, x].sum() for u, x in zip(us, labels) if u.label < 0)
            score += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
            for i, x in enumerate(labels):
                total[i, x] += np.exp(score)
        want = total / total.sum(axis=1, keepdims=True)
        assert len(skip) == (2 if loop else 0)
        assert abs(field.beliefs([us]) - want).max() < (0.1 if loop else 0.02)


def test_long_names_and_many_spans_stay_whole():
    address = "n" * 300 + "@" + ".".join(["d" * 90] * 9)
    text = f"{address} and {'m' * 200} [at] {'e' * 100} [dot] {'f' * 100}" + " [dot] g" * 9
    got = [text[u.start : u.end] for u in pii.units(text, pii.base_spans(text))]
    assert got == [address, text[len(address) + 5 :]]
    dense = "1.2.3.4 5.6.7.8 +1 555 123 4567 (a@b.cc) 4111111111111111"
    us = pii.units(dense, [(0, pii.IP, 7), (0, pii.IP, 3), (1, pii.IP, 2), (2, pii.IP, 3), (3, pii.IP, 4), (8, pii.CARD, 15)])
    assert us[0].label >= 0
    assert [x for x in pii._signs("a@b@c @ d@")] == [(0, 3), (3, 5), (6, 7), (8, 10)]
    began = time.perf_counter()
    pii.units("x" * 200_000 + "@" * 3 + "y" * 200_000, [])
    assert time.perf_counter() - began < 2


def test_odd_rows(spark, odd, none):
    field = teacher()
    got = pii.find(odd, field)
    assert len(got.collect()) == 11 and got.columns == [*odd.columns, "base", "spans"]
    assert pii.find(none, field).count() == 0
    assert pii.find_all(["1234567 " * 3000, "9" * 100_000, "@" * 5000, "a." * 20_000, "+1" * 5000], field)
    trained = pii.train(none)
    assert pii.find_all(["a@b.c 1234567"], trained)[0][0] == [(0, pii.EMAIL, 5)]


def test_query_columns(spark, tmp_path):
    frame(spark, [(1, "é a@b.cc and 1.2.3.4"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 0) and rows[1].spans.startswith("email:2:8,ip:13:20") and rows[2].spans == ""
