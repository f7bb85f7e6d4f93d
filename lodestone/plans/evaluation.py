"""Evaluation runs and the eight-step ablation: settings in, a table of means out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_text, token_count
from ..operators import chunking, dense, metrics, providers, query, sparse
from ..operators.ranking import META
from ..sources.tables import written
from . import retrieval
from .config import merge

# The steps of the ablation, each a change of the base settings.
STEPS: dict[str, dict] = {
    "01_baseline_dense_fixed": {"chunking": {"strategy": "fixed"}, "retrieval": {"type": "dense"}},
    "02_+section_chunking": {"chunking": {"strategy": "section"}, "retrieval": {"type": "dense"}},
    "03_bm25_only": {"chunking": {"strategy": "section"}, "retrieval": {"type": "bm25"}},
    "04_+hybrid_rrf": {"chunking": {"strategy": "section"}, "retrieval": {"type": "hybrid"}},
    "05_+reranker": {"chunking": {"strategy": "section"}, "retrieval": {"type": "hybrid"}, "reranker": {"enabled": True}},
    "06_+query_rewriting": {"chunking": {"strategy": "section"}, "retrieval": {"type": "hybrid"}, "reranker": {"enabled": True}, "query": {"rewriting": True}},
    "07_+multi_query": {"chunking": {"strategy": "section"}, "retrieval": {"type": "hybrid"}, "reranker": {"enabled": True}, "query": {"multi_query": True}},
    "08_parent_child": {"chunking": {"strategy": "parent_child"}, "retrieval": {"type": "hybrid"}, "reranker": {"enabled": True}},
}
RETRIEVAL = [f"{m}_{k}" for k in metrics.KS for m in ("recall", "precision", "hit")] + ["mrr", "ndcg_10"]
GENERATION = ["citation_correctness", "citation_completeness", "invalid_citation_rate", "answerable_success", "abstention_accuracy"]
LEAST_HITS = 10


def needs_model(settings: dict[str, Any]) -> bool:
    return bool(settings.get("query", {}).get("rewriting") or settings.get("query", {}).get("multi_query"))


class Corpus:
    """Chunks, index and vectors of one chunking, made when they are first asked for."""

    def __init__(self, documents: DataFrame, origin: DataFrame | None = None, embed: Callable | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None):
        """documents: document_id, pages; origin: document_id, title, authority, publication_date[, document_type], which may stand in documents
        instead: fixed windows then need no join.  keep writes a table and reads it again."""
        self.documents = documents
        origin = documents.drop("pages") if origin is None else origin
        self.origin = origin if "document_type" in origin.columns else origin.withColumn("document_type", F.lit(None).cast("string"))
        self.packed = embed is None
        self.embed = embed or providers.embedder("hashing")
        self.keep = keep or written
        self._made: dict[tuple, Any] = {}

    def _once(self, key: tuple, make: Callable[[], Any]) -> Any:
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def chunks(self, c: dict[str, Any]) -> DataFrame:
        sizes = chunking.Sizes(c["max_tokens"], c["overlap"], c["child_tokens"])

        def make() -> DataFrame:
            made = chunking.chunk(self.documents, c["strategy"], sizes)
            given = made if set(self.origin.columns) <= set(made.columns) else made.join(self.origin, "document_id")
            return self.keep(given.withColumn("id", F.col("chunk_id")), "chunks")

        return self._once(("chunks", c["strategy"], sizes), make)

    def retriever(self, settings: dict[str, Any]) -> retrieval.Retriever:
        """dense, bm25 or hybrid search over the chunks of these settings."""
        c, r = settings["chunking"], settings["retrieval"]
        p = self.chunks(c)
        headed = index_text(F.col("text"), F.col("section"), F.col("title"), F.col("authority"))
        text, embedded = (headed, headed) if c["contextual_header"] else (index_text(F.col("text"), F.col("section")), F.col("text"))
        key = (c["strategy"], c["max_tokens"], c["overlap"], c["child_tokens"], c["contextual_header"])

        def by_terms(queries: DataFrame, k: int) -> DataFrame:
            return sparse.search(self._once(("index", *key), lambda: sparse.build(p, "id", text, meta=True)), queries, k)

        def made() -> DataFrame:
            if self.packed:
                plain = self._made.get(("vectors", *key[:-1], False))
                if plain is not None:  # then only the headers' words are hashed
                    return self.keep(dense.headed_vectors(plain, F.col("head"), F.col("lead"), META), "vectors")
                if c["contextual_header"]:
                    return self.keep(dense.packed_vectors(p, "id", embedded, META), "vectors")
                head = index_text(F.when(F.col("text").isNotNull(), ""), F.col("section"), F.col("title"), F.col("authority"))
                return self.keep(dense.packed_vectors(p.withColumns({"head": head, "lead": dense.first_word(F.col("text"))}), "id", embedded, [*META, "head", "lead"]), "vectors")
            vectors = self.embed(p, "id", embedded, False)
            return self.keep(vectors.join(p.select("id", *META), "id"), "vectors")

        def by_vector(queries: DataFrame, k: int) -> DataFrame:
            asked = self.embed(queries, "query_id", F.col("text"), True).withColumnRenamed("id", "query_id")
            if "filter" in queries.columns:
                asked = asked.join(queries.select("query_id", "filter"), "query_id")
            return dense.search(self._once(("vectors", *key), made), asked, k)

        if r["type"] == "hybrid":
            return retrieval.hybrid(by_vector, by_terms, r["dense_top_k"], r["sparse_top_k"], r["rrf_k"], (r["dense_weight"], r["sparse_weight"]))
        return {"dense": by_vector, "bm25": by_terms}[r["type"]]


def evaluate(items: DataFrame, corpus: Corpus, settings: dict[str, Any], model: Callable | None = None, generation: bool = True, generate: Callable | None = None, judge: Callable | None = None, price: tuple[float, float] = (0.0, 0.0), patterns: dict | None = None) -> DataFrame:
    """A row for each of items(query_id, text, answerable, evidence, documents, ids[, question_type][, filter]), written.

    query_id, answerable, question_type, reference (whether the question names a document or an authority), retrieved (ids of the first
    hits), RETRIEVAL for answerable items; with generation GENERATION, tokens, cost, and the scores of the judge where there is one, for
    answers to answerable items.  The question is searched once: the hits that are measured and those that are answered from come from
    the same lists.  price: of a million tokens in and out.
    """
    chunks = corpus.chunks(settings["chunking"])
    search = retrieval.Search(items, corpus.retriever(settings), chunks, settings, model, LEAST_HITS, patterns)
    answerable = items.where("answerable")
    hits = written(search.hits(search.final).select("query_id", "rank", "id", "document_id", "page_start", "page_end"), "hits")
    covered, sizes = metrics.relevance(hits.join(answerable.select("query_id"), "query_id", "left_semi"), answerable)
    names = lambda h: F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    retrieved = hits.where(F.col("rank") <= LEAST_HITS).groupBy("query_id").agg(names(hits).alias("retrieved"))
    kind = F.col("question_type") if "question_type" in items.columns else F.lit("factual")
    named = search.queries.select("query_id", F.when(infer_named(search.queries, settings, patterns), "names_document_or_authority").otherwise("no_explicit_reference").alias("reference"))
    out = items.select("query_id", "answerable", kind.alias("question_type")).join(named, "query_id").join(retrieved, "query_id", "left")
    out = out.join(metrics.retrieval_metrics(covered, answerable, sizes), "query_id", "left")
    if generation:
        out = out.join(_answered(items, search, chunks, settings, generate, judge, price), "query_id", "left")
    return written(out, "evaluation")


def infer_named(queries: DataFrame, settings: dict[str, Any], patterns: dict | None = None) -> Column:
    """Whether a question names a document or an authority, whatever the settings say of filters."""
    text = query.normalise(F.col("text")) if settings["query"]["normalize"] else F.col("text")
    return query.infer_filter(text, **(patterns or {})).isNotNull()


def _answered(items: DataFrame, search: retrieval.Search, chunks: DataFrame, settings: dict[str, Any], generate: Callable | None, judge: Callable | None, price: tuple[float, float]) -> DataFrame:
    shown = written(search.hits(), "shown")
    answers = written(retrieval.answer(shown, items, chunks, settings, generate), "answers")
    cited = answers.select("query_id", F.explode(F.concat(F.transform("citations", lambda c: F.struct(c.alias("id"), F.lit(True).alias("valid"))), F.transform("invalid", lambda c: F.struct(c.alias("id"), F.lit(False).alias("valid"))))).alias("c")).select("query_id", "c.*")
    places = shown.select("query_id", "id", "document_id", "page_start", "page_end")
    cited = written(cited.join(places, ["query_id", "id"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))), "cited")
    relevant = metrics.relevance(cited.where("valid"), items)[0].select("query_id", "rank").distinct().withColumn("relevant", F.lit(True))
    judged = cited.join(relevant, ["query_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    wanted = F.when(F.size("documents") > 0, F.col("documents")).otherwise(F.array_distinct(F.transform("evidence", lambda e: e["document_id"])))
    citations = metrics.citation_metrics(judged, items.select("query_id", "answerable", F.coalesce(wanted, F.array().cast("array<string>")).alias("documents")))
    success, abstention = metrics.answerability(F.col("answerable"), F.col("insufficient"))
    tokens = (F.col("context_tokens") + token_count(F.col("text"))).alias("prompt_tokens"), token_count(F.col("answer")).alias("completion_tokens")
    rows = items.select("query_id", "text", "answerable").join(answers, "query_id")
    out = rows.select("query_id", "answer", "insufficient", F.col("citations").alias("cited"), success.alias("answerable_success"), abstention.alias("abstention_accuracy"), *tokens).join(citations, "query_id")
    out = out.withColumn("cost", metrics.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(price[0]), F.lit(price[1])))
    if judge is None:
        return out
    texts = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    asked = rows.where("answerable AND NOT insufficient").join(texts, "query_id").select("query_id", F.col("text").alias("question"), "answer", "context")
    scores = written(providers.judge(asked, judge).drop("question", "answer", "context"), "judged")
    return out.join(scores, "query_id", "left")


def summary(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Means of evaluate()'s rows over all items, by question type and by reference: (question_type, reference, n, answerable, means, sums of
    tokens and cost); what a row isn't grouped by is null.  A mean is over the rows that have a value."""
    numbers = [c for c in (*RETRIEVAL, *GENERATION, *(f"judge_{n}" for n in providers.SCORES)) if c in rows.columns]
    sums = [c for c in ("prompt_tokens", "completion_tokens", "cost") if c in rows.columns]
    kind, reference = F.col("question_type"), F.col("reference")
    parts = [
        F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("answerable"),
        *[F.round(F.avg(c), digits).alias(c) for c in numbers], *[F.sum(c).alias(c) for c in sums],
    ]
    return rows.groupingSets([[], [kind], [reference]], kind, reference).agg(*parts)


def ablation(items: DataFrame, corpus: Corpus, base: dict[str, Any], model: Callable | None = None, steps: dict[str, dict] | None = None, generation: bool = True, **options: Any) -> DataFrame:
    """(step, name, experiment, latency_ms, the columns of summary()) of each step; latency_ms is the step's time for a question.

    Every step is one evaluation, whose rows are written; steps that reword questions need a model.
    """
    steps = STEPS if steps is None else steps
    items = written(items, "items")  # every step reads them several times
    if model is None and any(needs_model(merge(base, change)) for change in steps.values()):
        raise ValueError("steps that reword questions need a model: " + ", ".join(n for n, change in steps.items() if needs_model(merge(base, change))))

    def run(settings: dict[str, Any]) -> DataFrame:
        began = time.perf_counter()
        rows = evaluate(items, corpus, settings, model if needs_model(settings) else None, generation, **options)
        took = (time.perf_counter() - began) * 1000
        return summary(rows).withColumn("latency_ms", F.round(F.lit(took) / F.greatest(F.col("n"), F.lit(1)), 2))

    return retrieval.ablation(steps, run, base)


def report(rows: DataFrame, settings: dict[str, Any], name: str, path: str) -> DataFrame:
    """Write an experiment: its settings, its means and a row for each question as JSON lines; its id is name and fingerprint."""
    from ..sources.stores import write_jsonl
    from .config import experiment_id

    means = summary(rows).withColumns({"experiment": F.lit(experiment_id(name, settings)), "settings": F.lit(json.dumps(settings, sort_keys=True))})
    write_jsonl(means, f"{path}/{experiment_id(name, settings)}/means")
    write_jsonl(rows, f"{path}/{experiment_id(name, settings)}/questions")
    return means
