"""Evaluation runs, the ablation and the command line on a small corpus whose answers are known."""

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.operators import providers
from lodestone.plans import evaluation, retrieval
from lodestone.plans.config import load, merge
from lodestone.streaming import traces

TOPICS = {"harbour": "Ships anchor in the outer harbour while storms last.", "bridge": "Carts cross the northern bridge before sunrise.", "mill": "Millers grind barley behind the western wall.", "garden": "Gardeners water roses after evening prayers."}
FILLER = "Nothing else is known about this place; it is quiet and old."


@pytest.fixture(scope="module")
def corpus(spark):
    pages = lambda t: [(1, f"{t.capitalize()}\n{TOPICS[t]}\n{FILLER}", None, [t.capitalize()]), (2, FILLER + f" Page two of {t}.", None, [])]
    docs = spark.createDataFrame([(t, pages(t)) for t in TOPICS], "document_id string, pages array<struct<page_number: int, text: string, section: string, headings: array<string>>>")
    origin = docs.select("document_id", F.lit("T").alias("title"), F.lit("EBA").alias("authority"), F.lit(None).cast("date").alias("publication_date"))
    return evaluation.Corpus(docs, origin)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Where do ships anchor while storms last?", True, [("harbour", [1])], ["harbour"], []),
        (2, "When do carts cross the northern bridge?", True, [], ["bridge"], []),
        (3, "Who grinds barley behind the western wall?", True, [], [], ["mill:section:00000", "mill:fixed:00000", "mill:parent_child:00000"]),
        (4, "Which zebras juggle copper lanterns?", False, [], [], []),
    ]
    return spark.createDataFrame(rows, "query_id long, text string, answerable boolean, evidence array<struct<document_id: string, pages: array<int>>>, documents array<string>, ids array<string>")


def test_an_evaluation_run(corpus, items):
    settings = merge(load(env={}), {"chunking": {"max_tokens": 40, "overlap": 4, "child_tokens": 20}})
    got = {r.query_id: r for r in evaluation.evaluate(items, corpus, settings).collect()}
    assert [got[i].hit_1 for i in (1, 2, 3)] == [1.0] * 3 and got[4].recall_1 is None
    assert got[1].recall_10 == got[2].recall_10 == 1.0 and got[1].mrr == 1.0 and got[1].ndcg_10 == 1.0
    assert [got[i].citation_correctness for i in (1, 2, 3)] == [1.0] * 3
    assert [got[i].answerable_success for i in (1, 2, 3)] == [1.0] * 3 and got[4].abstention_accuracy == 1.0 and got[4].citation_correctness is None


def test_the_eight_steps(corpus, items, tmp_path):
    asked = tmp_path / "asked"

    def model(prompts):
        with open(asked, "a") as f:
            f.writelines(user.replace("\n", " ") + "\n" for _, user in prompts)
        return [user.split("\n", 1)[1] for _, user in prompts]

    base = merge(load(env={}), {"chunking": {"max_tokens": 40, "overlap": 4, "child_tokens": 20}, "reranker": {"candidates": 10}})
    assert len(evaluation.STEPS) == 8
    rows = evaluation.ablation(items, corpus, base, model).where("question_type IS NULL AND reference IS NULL").orderBy("step").collect()
    assert [r.name for r in rows] == list(evaluation.STEPS) and {(r.n, r.answerable) for r in rows} == {(4, 3)} and len({r.experiment for r in rows}) == 8
    # step 02 names other chunks than item 3 does under "fixed"; all find what they look for
    assert all(r.recall_10 > 0.6 and r.mrr > 0.6 and r.answerable_success == 1.0 and r.latency_ms > 0 for r in rows)
    calls = asked.read_text().splitlines()
    assert len(calls) == 8 and len(set(calls)) == 8  # four questions, rewritten once and varied once, though many plans read them
    with pytest.raises(ValueError, match="06_.*07_"):
        evaluation.ablation(items, corpus, base)
    with pytest.raises(ValueError, match="need a model"):
        evaluation.evaluate(items, corpus, merge(base, {"query": {"rewriting": True}}))
    table = retrieval.markdown(evaluation.ablation(items, corpus, base, None, {"b": evaluation.STEPS["03_bm25_only"]}, generation=False))
    assert table.startswith("| step | name | experiment | question_type | reference | n |")


def test_a_contextual_header_reaches_the_vectors(spark, corpus):
    """The authority stands in the header alone: with it on, dense search finds it, else all scores are 0."""
    q = spark.createDataFrame([(1, "EBA")], "query_id long, text string")
    for header in (False, True):
        settings = merge(load(env={}), {"chunking": {"contextual_header": header}, "retrieval": {"type": "dense"}})
        best = corpus.retriever(settings)(q, 3).collect()
        assert (best[0].score > 0) == header


def test_answers_are_measured(spark, corpus, items):
    settings = merge(load(env={}), {"chunking": {"max_tokens": 40, "overlap": 4, "child_tokens": 20}})

    def generate(shown, asked):
        """Two citations, one of which was never shown; nothing for the last question."""
        first = shown.where("rank = 1").select("query_id", F.col("id").alias("cited"))
        return asked.join(first, "query_id").select("query_id", F.lit("three words here").alias("answer"), F.when(F.col("query_id") == 2, F.lit("invented")).otherwise(F.col("cited")).alias("cited"), (F.col("query_id") == 4).alias("insufficient"))

    judge = lambda rows: ['{"faithfulness": 1, "answer_relevance": 0.5, "context_relevance": 0.25}' for _ in rows]
    kinds = items.withColumn("question_type", F.when(F.col("query_id") < 3, "factual").otherwise("ambiguous"))
    rows = evaluation.evaluate(kinds, corpus, settings, generate=generate, judge=judge, price=(1.0, 10.0))
    got = {r.query_id: r for r in rows.collect()}
    assert [got[i].citation_correctness for i in (1, 2, 3)] == [1.0, 0.0, 1.0] and got[4].citation_correctness is None
    assert [got[i].citation_completeness for i in (1, 2, 3)] == [1.0, 0.0, 0.0]  # item 3 names no document
    assert [got[i].invalid_citation_rate for i in (1, 2, 3)] == [0.0, 1.0, 0.0]
    assert got[2].insufficient and got[2].answerable_success == 0.0 and got[4].abstention_accuracy == 1.0  # an answer without a valid citation is withheld
    assert got[1].judge_faithfulness == 1.0 and got[2].judge_faithfulness is None and got[4].judge_faithfulness is None
    assert got[1].completion_tokens == 3 and abs(got[1].cost - (got[1].prompt_tokens + 30) / 1e6) < 1e-12
    means = {(r.question_type, r.reference): r for r in evaluation.summary(rows).collect()}
    assert set(means) == {(None, None), ("factual", None), ("ambiguous", None), (None, "no_explicit_reference")}
    assert means[("factual", None)].citation_correctness == 0.5 and means[(None, None)].n == 4 and means[("ambiguous", None)].answerable == 1
    assert means[(None, None)].mrr == round(sum(got[i].mrr for i in (1, 2, 3)) / 3, 6)


def test_named_chunks_count_for_rank_but_not_for_recall_beside_evidence(spark):
    from lodestone.operators import metrics

    hits = spark.createDataFrame([("q", 1, "x", "d1", 1, 1), ("q", 2, "y", "d1", 2, 4), ("q", 3, "z", "d2", 1, 9)], "query_id string, rank int, id string, document_id string, page_start int, page_end int")
    items = spark.createDataFrame([("q", [("d1", [3, 7])], [], ["x"])], "query_id string, evidence array<struct<document_id: string, pages: array<int>>>, documents array<string>, ids array<string>")
    covered, sizes = metrics.relevance(hits, items)
    r = metrics.retrieval_metrics(covered, items, sizes).first()
    assert (r.recall_1, r.recall_3, r.precision_1, r.precision_3, r.mrr) == (0.0, 0.5, 1.0, round(2 / 3, 6), 1.0)


def test_wordings_and_judgements(spark):
    q = spark.createDataFrame([(1, "old words")], "query_id long, normalised string")
    got = providers.reworded(q, lambda rows: ['"new words"' if "Word this" in u else "- a\n* b" for _, u in rows], n=1).first()
    assert got.rewritten == "new words" and got.variants == ["a"]
    assert providers.reworded(q, None, rewriting=False).first().variants is None
    two = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "query_id long, normalised string")
    assert {r.query_id: r.rewritten for r in providers.reworded(two, lambda rows: [f"reply {len(rows)}" for _ in rows]).collect()} == {1: "reply 1", 2: "reply 1", 3: None}
    replies = ['x {"faithfulness": 1, "answer_relevance": 0.2, "context_relevance": 0, "more": 5}', '{"faithfulness": 1}', '{"faithfulness": -0.1, "answer_relevance": 1, "context_relevance": 1}', "none"]
    rows = spark.createDataFrame([(r,) for r in replies], "reply string").select(providers.judgements(F.col("reply")).alias("j")).collect()
    assert [r.j for r in rows] == [{"faithfulness": 1.0, "answer_relevance": 0.2, "context_relevance": 0.0}, None, None, None]


def test_embedders(spark):
    assert providers.prefixes("intfloat/E5-small") == ("query: ", "passage: ") and providers.prefixes("bge-m3") == ("", "") and providers.prefixes("bge-base-en")[1] == ""
    with pytest.raises(ValueError, match="unknown embedding provider"):
        providers.embedder("elsewhere")
    made = []
    assert providers.load_once("m", lambda: made.append(1) or 5) == 5 == providers.load_once("m", lambda: made.append(1)) and made == [1]


def test_requests_as_json(spark):
    bodies = ['{"query": "fine words", "filters": {"authority": ["EBA"], "publication_date_gte": "2020-01-01"}, "top_k": 3}', '{"query": "fine words", "colour": 1}', '{"query": "fine words", "filters": {"colour": 1}}', "[1]", "", '{"query": "fine words", "top_k": 0}']
    rows = providers.parse_requests(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"), ("EBA",)).orderBy("i").collect()
    assert [r.problem for r in rows] == [None, "unknown field", "unknown field", "not a JSON object", "not a JSON object", "top_k out of range"]
    assert str(rows[0].filters.publication_date_gte) == "2020-01-01" and rows[0].top_k == 3


def test_trace_records(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 2, "y", 0.5), (1, 1, "x", 0.9)], "query_id long, rank int, id string, score double")
    shown = spark.createDataFrame([(1, ["x"], "one two three")], "query_id long, ids array<string>, context string")
    answers = spark.createDataFrame([(1, "yes it is", False, ["z"])], "query_id long, answer string, insufficient boolean, invalid array<string>")
    rows = {r.request_id: r for r in traces.records(q, hits, shown, answers, "hybrid", price=(1.0, 2.0)).collect()}
    assert rows["1"].retrieved_chunk_ids == ["x", "y"] and rows["1"].context_chunk_ids == ["x"] and rows["1"].invalid_citations == ["z"] and abs(rows["1"].estimated_cost - 9e-6) < 1e-12
    assert rows["2"].retrieved_chunk_ids == [] and rows["2"].insufficient_evidence


def test_command_line(spark, tmp_path, capsys):
    docs = [(i, f"{t} {FILLER}") for i, t in enumerate(TOPICS.values())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    rows = [(7, "Where do ships anchor while storms last?", True, ["0"]), (8, "Which zebras juggle copper lanterns?", False, [])]
    spark.createDataFrame(rows, "item_id long, text string, answerable boolean, documents array<string>").write.parquet(str(tmp_path / "items"))
    both = ["--documents", str(tmp_path / "docs"), "--queries", str(tmp_path / "items"), "--out"]
    main(["ask", *both, str(tmp_path / "answers")])
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert got[7].citations == ["0:section:00000"] and got[8].insufficient
    main(["eval", *both, str(tmp_path / "eval"), "--report", str(tmp_path / "report")])
    assert spark.read.json(str(tmp_path / "report/*/means")).where("question_type IS NULL AND reference IS NULL").first().hit_1 == 1.0
    assert spark.read.json(str(tmp_path / "report/*/questions")).count() == 2
    assert {r.query_id: r.hit_1 for r in spark.read.parquet(str(tmp_path / "eval")).collect()} == {7: 1.0, 8: None}
    main(["ablation", *both, str(tmp_path / "ablation"), "--steps", "03_bm25_only"])
    assert spark.read.parquet(str(tmp_path / "ablation")).where("question_type IS NULL AND reference IS NULL").first().recall_1 == 1.0
    store = str(tmp_path / "collection")
    main(["ingest", "--documents", str(tmp_path / "docs"), "--collection", store])
    assert spark.read.json(f"{store}/reports").first().chunks_generated == 4
    for args in ([], ["--authority", "nobody"]):
        main(["ask", "--collection", store, "--queries", str(tmp_path / "items"), "--traces", str(tmp_path / "traces"), "--out", str(tmp_path / "again"), *args])
        found = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "again")).collect()}
        assert found[7].insufficient == bool(args) and (args or (found[7].citations == ["0:section:00000"] and found[7].sources[0].label.endswith("p.1]") and found[7].retrieved[0].id == "0:section:00000"))
    assert spark.read.json(str(tmp_path / "traces")).count() == 4
    with pytest.raises(SystemExit):
        main(["ask", "--documents", str(tmp_path / "docs")])
