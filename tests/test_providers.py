import json

import pytest

from lodestone.operators import providers


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "query_id long, text string")
    assert {r.query_id: r.vector for r in providers.embed(df, lambda xs: [[float(len(x))] for x in xs], prefix="q: ").collect()} == {1: [5.0], 2: [4.0]}
    hits = spark.createDataFrame([(1, 1, "x", "short", 0.5), (1, 2, "y", "a longer text", 0.4), (1, 3, "z", "short", 0.3)], "query_id long, rank int, id string, text string, score double")
    got = providers.rerank(hits, df, lambda xs: [float(len(t)) for _, t in xs], 2).orderBy("rank").collect()
    assert [(r.id, r.pre_rerank_score) for r in got] == [("y", 0.4), ("x", 0.5)]
    prompts = spark.createDataFrame([("s", "u")], "system string, user string")
    scores = dict.fromkeys(providers.SCORES, 0.5)
    out = providers.generate(prompts, lambda xs: [f"ok {json.dumps(scores)}" for _ in xs])
    assert out.select(providers.judgements(out.reply).alias("j")).first().j == scores


def test_only_transient_errors_are_tried_again():
    class Failed(Exception):
        def __init__(self, status):
            self.status = status

    calls = []

    def call(status):
        calls.append(status)
        raise Failed(status)

    for status, times in ((503, 4), (400, 1)):
        calls.clear()
        with pytest.raises(Failed):
            providers.retried(call, sleep=lambda s: None)(status)
        assert len(calls) == times


def test_requests(spark):
    rows = [("  ", 5, None), ("x" * 2000, 5, None), ("good query", 99, None), ("good query", 5, ["XX"]), ("good query", None, ["EBA"])]
    df = spark.createDataFrame(rows, "query string, top_k int, authority array<string>")
    assert [r.problem for r in providers.check_requests(df, ("EBA",)).collect()] == ["query too short", "query too long", "top_k out of range", "unknown authority", None]
