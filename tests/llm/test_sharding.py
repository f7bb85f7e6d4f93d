import random
import zlib

from pyspark.sql import functions as F

from lodestone.llm.sharding import find_splitters, shard_by_bytes, windows_of

from .conftest import frame


def placed(df, n):
    rows = shard_by_bytes(df, n).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    return rows, by


def test_balance_slots_and_sums(spark):
    texts = [(i, "x" * (i * 37 % 400)) for i in range(3000)] + [(5000 + i, "the same text " * 10) for i in range(1500)]
    rows, by = placed(frame(spark, texts), 6)
    want = {i: (len(t) + 8, zlib.crc32(t.encode())) for i, t in texts}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want
    assert set(by) == set(range(6))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sums = [sum(r.size for r in part) for part in by.values()]
    assert max(sums) - min(sums) <= 2 * 408 + 0.01 * sum(sums) / 6


def test_odd_rows(odd):
    rows, by = placed(odd, 24)
    assert len(rows) == 11 and {r.size for r in rows if r.doc_id == 1} == {8}
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))


def test_one_shard_and_repeats(spark):
    rows, by = placed(frame(spark, [(1, "é")] * 50), 1)
    assert {r.shard for r in rows} == {0} and sorted(r.slot for r in rows) == list(range(50)) and {r.size for r in rows} == {10}
    rows, by = placed(frame(spark, [(1, "same")] * 400), 4)
    assert max(map(len, by.values())) <= 110


def brute(rows, shards):
    """Rows by sort key, cut where the bytes below come nearest to each target."""
    rows = sorted(rows)
    below = [0]
    for _, size in rows:
        below.append(below[-1] + size)
    cuts = [min(range(len(below)), key=lambda i: (abs(below[i] - below[-1] * s / shards), i)) for s in range(1, shards)]
    return [rows[c][0] if c < len(rows) else 1 << 62 for c in cuts]


def test_splitters_against_brute_force(spark):
    rnd = random.Random(2)
    for shards in (2, 5, 9):
        rows = [(rnd.choice([rnd.getrandbits(62), (77 << 40) + rnd.randrange(300)]), rnd.randint(8, 400)) for _ in range(700)]
        df = spark.createDataFrame(rows, "k long, size long")
        total = sum(n for _, n in rows)
        got = find_splitters(df, [total * i / shards for i in range(1, shards)], 0.0)
        below = lambda s: sum(n for k, n in rows if k < s)
        for i, (mine, theirs) in enumerate(zip(got, brute(rows, shards)), 1):
            assert abs(below(mine) - total * i / shards) <= abs(below(theirs) - total * i / shards) + 1e-6


def test_many_rows_are_numbered_in_cuts(spark):
    texts = [(i, f"t{i}") for i in range(2000)] + [(5000 + i, "one text") for i in range(800)]
    want = {(r.doc_id, r.shard) for r in shard_by_bytes(frame(spark, texts), 3).collect()}
    rows = shard_by_bytes(frame(spark, texts), 3, rows_per_task=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert len(rows) == 2800 and len(want) == 2800
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    copies = sorted((r.shard, r.slot) for r in rows if r.doc_id >= 5000)
    assert sum(b != a + 1 for (s, a), (t, b) in zip(copies, copies[1:]) if s == t) == 0  # equal texts lie side by side


def test_empty_table(none):
    assert shard_by_bytes(none, 24).count() == 0


def test_no_python_in_the_plan(spark):
    plan = shard_by_bytes(frame(spark, [(1, "a"), (2, "b")]), 3)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_window_has_few_rows_whatever_their_texts(spark):
    """Half of the rows are empty texts, a third are copies of one: windows are cut by counted rows all the same."""
    rows = [(i, "" if i % 2 else "the same long text, again and again" if i % 3 else f"text {i} " * (i % 7)) for i in range(6000)]
    docs = frame(spark, rows)
    out = shard_by_bytes(docs, 3, parts=2, rows_per_task=50)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.collect()
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    weight = [sum(r["size"] for r in got if r.shard == s) for s in range(3)]
    assert max(weight) - min(weight) < 0.02 * sum(weight) and len(got) == len(rows)
    # the rows that one window task numbers: those that stand before the window in the plan, by its partition
    sizes = [r.n for r in windows_of(docs, 3, parts=2, rows_per_task=50).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 100
