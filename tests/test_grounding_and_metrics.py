import statistics

from pyspark.sql import functions as F

from lodestone.operators import context as ctx
from lodestone.operators import grounding, metrics, review
from lodestone.plans import config, retrieval

RAW_ANSWERS = (
    '{"answer": "Yes.", "citations": [{"chunk_id": "a"}], "insufficient_evidence": false}', '```json\n{"answer": "Fenced", "citations": []}\n```', 'So: {"answer": "Inside", "citations": [{"chunk_id": "b"}]} indeed',
    "no json at all", '{"answer": 1}', '{"answer": "x", "citations": "a"}', '{"citations": []}', "",
)

HIT = "query_id long, rank int, id string, text string, document_id string, page_start int, page_end int, section string, title string, authority string, publication_date date, parent_id string, parent_text string"


def hits(spark, rows):
    return spark.createDataFrame([(1, r, i, t, d, p, p, None, "T", "EBA", None, parent, text) for r, (i, t, d, p, parent, text) in enumerate(rows, 1)], HIT)


def test_budget_skips_and_goes_on(spark):
    rows = [(f"a{i}", " ".join(f"w{i}_{j}" for j in range(400)), "A", i, None, None) for i in range(6)] + [("b", "short text of b", "B", 1, None, None)]
    out = ctx.build(hits(spark, rows), 1300, 2).first()
    assert out.ids == ["a0", "a1", "b"] and out.dropped == 0
    out = ctx.build(hits(spark, rows), 500, 4).first()
    assert out.ids == ["a0", "b"] and out.dropped == 5 and "[chunk_id: b] EBA — T | p.1 | None\nshort text of b" in out.context


def test_one_child_of_a_parent(spark):
    rows = [("c1", "alpha beta", "A", 1, "p", "the whole parent"), ("c2", "gamma delta", "A", 2, "p", "the whole parent")]
    out = ctx.build(hits(spark, rows)).first()
    assert out.ids == ["c1"] and "the whole parent" in out.context


def test_label_and_neighbours(spark):
    row = hits(spark, [("c", "t", "A", 4, None, None)]).withColumn("section", F.lit("Art. 1"))
    assert row.select(grounding.label().alias("x")).first().x == "[EBA — T, §Art. 1, p.4]"
    chunks = spark.createDataFrame([(f"c{i}", "A", i, f"t{i}", i, i) for i in range(5)], "chunk_id string, document_id string, position int, text string, page_start int, page_end int")
    wide = ctx.expand(hits(spark, [("c2", "t2", "A", 2, None, None)]), chunks, 1).first()
    assert wide.text == "t1\nt2\nt3" and (wide.page_start, wide.page_end) == (1, 3)


def test_replies(spark):
    df = spark.createDataFrame(list(enumerate(RAW_ANSWERS)), "i int, raw string").select("i", grounding.parse_answer(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [r.p.answer for r in df[:3]] == ["Yes.", "Fenced", "Inside"] and df[0].p.citations == ["a"]
    assert all(r.p.answer == grounding.INSUFFICIENT and r.p.insufficient_evidence for r in df[3:])


def test_citations_must_have_been_shown(spark):
    answers = spark.createDataFrame([(1, [" a ", "a", "ghost"]), (2, [])], "query_id long, citations array<string>")
    shown = spark.createDataFrame([(1, "a")], "query_id long, id string")
    got = {(r.id, r.valid) for r in grounding.check_citations(answers, shown, shown).collect()}
    assert got == {("a", True), ("ghost", False)}


def test_answers_end_to_end(spark):
    rows = hits(spark, [("a", "Institutions should verify customer identity. More text.", "A", 1, None, None), ("b", "Unrelated words entirely.", "B", 1, None, None)])
    questions = spark.createDataFrame([(1, "How should institutions verify identity?"), (2, "Anything on moon landings?")], "query_id long, text string")
    got = {r.query_id: r for r in retrieval.answer(rows, questions, rows.select("id"), config.load(env={})).collect()}
    assert got[1].answer == "Institutions should verify customer identity." and got[1].citations == ["a"] and not got[1].insufficient
    assert got[2].insufficient and got[2].answer == grounding.INSUFFICIENT and got[2].context_tokens == 0


def test_metrics_of_page_units(spark):
    units = spark.createDataFrame([(1, "A1", "A", 1), (1, "A2", "A", 2), (2, "B", "B", None)], "query_id long, unit string, document_id string, page int")
    found = spark.createDataFrame([(1, 1, "A", 1, 2), (1, 2, "A", 1, 1), (1, 3, "C", 1, 1), (2, 1, "C", 1, 1), (2, 2, "B", 9, 9)], "query_id long, rank int, document_id string, page_start int, page_end int")
    sizes = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query_id long, n_units long")
    got = {r.query_id: r for r in metrics.retrieval_metrics(metrics.cover(found, units), sizes, sizes).collect()}
    assert got[1].recall_1 == 1.0 and got[1].precision_3 == round(2 / 3, 6) and got[1].mrr == 1.0 and got[1].ndcg_10 < 1
    assert got[2].hit_1 == 0.0 and got[2].recall_3 == 1.0 and got[2].mrr == 0.5
    assert got[3].recall_10 == 0.0 and got[3].ndcg_10 == 0.0


def test_repeated_pages_never_exceed_one(spark):
    covered = spark.createDataFrame([(1, 1, "u"), (1, 2, "u"), (1, 3, "u")], "query_id long, rank int, unit string")
    sizes = spark.createDataFrame([(1, 1)], "query_id long, n_units long")
    assert metrics.retrieval_metrics(covered, sizes, sizes).first().ndcg_10 == 1.0


def test_both_percentiles(spark):
    values = [3.0, 1.0, 8.0, 2.5, 9.0, 4.0, 7.0]
    for v in (values, values[:2], values[:1]):
        df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
        want = [statistics.quantiles(v, n=100)[p - 1] if len(v) > 1 else v[0] for p in (50, 95)]
        r = metrics.exact_quantiles(df, "g", "v").first()
        assert [r.p50, r.p95] == [round(x, 6) for x in want]
        a = df.groupBy("g").agg(F.collect_list("v").alias("a")).select(*[metrics.quantile_exclusive(F.col("a"), p).alias(f"p{p}") for p in (50, 95)], metrics.service_percentile(F.col("a"), 0.5).alias("s")).first()
        assert [round(a.p50, 6), round(a.p95, 6)] == [round(x, 6) for x in want] and a.s == sorted(v)[round(0.5 * (len(v) - 1))]


def test_review_picks_the_best_window(spark):
    text = "filler words only. " * 60 + "the customer identity check " * 3 + "filler words only. " * 60
    x = spark.createDataFrame([(text, "customer identity")], "t string, q string").select(review.best_window(F.col("t"), F.col("q")).alias("x")).first().x
    assert x.startswith("…") and "customer identity" in x and len(x) == 601


def test_settings_and_experiments(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("retrieval:\n  rrf_k: 10\n")
    s = config.load(str(path), {"context": {"max_tokens": 5}}, {"LODESTONE__RETRIEVAL__FINAL_TOP_K": "3", "OTHER": "x"})
    assert (s["retrieval"]["rrf_k"], s["retrieval"]["final_top_k"], s["context"]["max_tokens"], s["retrieval"]["dense_top_k"]) == (10, 3, 5, 20)
    assert config.experiment_id("a", {"y": 1, "x": 2}) == config.experiment_id("a", {"x": 2, "y": 1})


def test_ablation_table(spark):
    out = retrieval.ablation({"base": {}, "deep": {"retrieval": {"rrf_k": 5}}}, lambda c: spark.createDataFrame([(float(c["retrieval"]["rrf_k"]),)], "mrr double"), config.load(env={}))
    assert [r.mrr for r in out.orderBy("step").collect()] == [60.0, 5.0] and retrieval.markdown(out).count("\n") == 3
