"""Retrieval plans for whole tables of queries: hybrid search, filter modes, answers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from ..operators import context as ctx
from ..operators import fusion, grounding
from ..operators.providers import reworded
from ..operators.query import AUTHORITIES, DOCUMENTS, FILTER, as_filter, expand_acronyms, infer_filter, is_empty, normalise, retrieval_queries
from ..operators.ranking import META
from ..operators.sparse import passes as passes_filter
from ..sources.tables import written

ALL = 1 << 30

#: A retriever takes (queries(query_id, text[, filter]), k) and returns (query_id, rank, id, score).
Retriever = Callable[[DataFrame, int], DataFrame]


def as_list(hits: DataFrame, no: int, name: str) -> DataFrame:
    return hits.select("query_id", F.lit(no).alias("list_no"), "rank", "id", F.lit(name).alias("retriever"))


def hybrid(dense: Retriever, sparse: Retriever, dense_k: int = 20, sparse_k: int = 20, rrf_k: int = fusion.RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> Retriever:
    def search(queries: DataFrame, k: int) -> DataFrame:
        lists = as_list(dense(queries, dense_k), 0, "dense").union(as_list(sparse(queries, sparse_k), 1, "bm25"))
        return fusion.rrf(lists, k, rrf_k, dict(enumerate(weights)))

    return search


def fan_out(retriever: Retriever, variants: DataFrame, k: int, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """One search for several wordings: variants(query_id, list_no, text), fused without weights."""
    flat, lists = worded_lists(retriever, variants, k)
    named = lists.join(broadcast_if_small(flat.select("wording", "query_id", "list_no")), "wording")
    return fusion.rrf(named.select("query_id", "list_no", "rank", "id", F.lit("retriever").alias("retriever")), k, rrf_k)


def worded_lists(retriever: Retriever, variants: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(variants with their number wording, hits(wording, rank, id, score) of each).  The numbers stand in a table that is written before
    anything is searched: plans that gave them again would give others."""
    flat = written(variants.withColumn("wording", F.monotonically_increasing_id()), "wordings")
    asked = flat.select(F.col("wording").alias("query_id"), "text", *(["filter"] if "filter" in flat.columns else []))
    return flat, retriever(asked, k).withColumnRenamed("query_id", "wording").select("wording", "rank", "id", "score")


def filtered(mode: str, unrestricted: DataFrame, restricted: DataFrame, matches: Column, inferred: Column, k: int, ranks: int = 5) -> DataFrame:
    """(query_id, rank, id) under an inferred filter.

    unrestricted and restricted are ranked hits without and with the filter; matches says of an
    unrestricted hit whether it passes, and inferred whether its query has a filter at all.  boost moves
    matching hits up; restrict takes the restricted ones; restrict_with_fallback alternates both lists.
    """
    plain = unrestricted.where(~inferred)
    named = unrestricted.where(inferred)
    if mode == "boost":
        out = fusion.boost(named, matches, ranks)
    elif mode == "restrict":
        out = restricted
    elif mode == "restrict_with_fallback":
        lists = as_list(restricted, 0, "restricted").union(as_list(named, 1, "unrestricted"))
        out = fusion.interleave(lists, k)
    else:
        raise ValueError(f"unknown filter mode {mode}")
    columns = ["query_id", "rank", "id"]
    return fusion.dealt(out.select(columns).union(plain.select(columns)).where(F.col("rank") <= k), "rank")


def process(queries: DataFrame, settings: dict[str, Any], documents: dict[str, str] = DOCUMENTS, authorities: dict[str, str] = AUTHORITIES) -> DataFrame:
    """queries(query_id, text) with normalised text and inferred filter; the filter sees the text before expansion.

    documents and authorities: names with the patterns that name them.
    """
    norm = normalise(F.col("text")) if settings["query"]["normalize"] else F.col("text")
    out = queries.withColumn("_n", norm)
    inferred = infer_filter(F.col("_n"), documents, authorities) if settings["retrieval"]["infer_filters"] else F.lit(None).cast("struct<document_id: array<string>, authority: array<string>>")
    return out.withColumn("normalised", expand_acronyms(F.col("_n"))).withColumn("inferred", inferred).drop("_n")


MODES = ("boost", "restrict", "restrict_with_fallback")
MAIN, RESTRICTED = 1, 0  # passes of a query: by its explicit filter, and by an inferred one


class Search:
    """Retrieval of a table of questions under settings, each step once: wordings and filters, one search for all passes and
    wordings, and from its written lists the hits for any number that is wanted.

    questions: query_id, text[, filter].  A filter that restricts something keeps one from being inferred.  restrict searches under the
    inferred filter, boost moves hits that pass it up, restrict_with_fallback alternates a restricted and an unrestricted list.
    """

    def __init__(self, questions: DataFrame, retriever: Retriever, chunks: DataFrame, settings: dict[str, Any], model: Callable | None = None, most: int = 0, patterns: dict[str, dict[str, str]] | None = None):
        """most: the largest number of hits that will be asked for, if more than settings have; patterns: of process()."""
        q, r = settings["query"], settings["retrieval"]
        if r["infer_filters"] and r["filter_mode"] not in MODES:
            raise ValueError(f"unknown filter mode {r['filter_mode']}")
        if (q["rewriting"] or q["multi_query"]) and model is None:
            raise ValueError("query.rewriting and query.multi_query need a model")
        self.settings, self.chunks = settings, chunks
        self.worded = q["multi_query"]
        own = F.col("filter") if "filter" in questions.columns else F.lit(None).cast(FILTER)
        asked = process(questions.select("query_id", "text", own.alias("filter")), settings, **(patterns or {}))
        if model is not None:
            asked = reworded(asked, model, q["rewriting"], q["multi_query_n"] if q["multi_query"] else 0)
        else:
            asked = asked.withColumns({"rewritten": F.lit(None).cast("string"), "variants": F.lit(None).cast("array<string>")})
        asked = asked.withColumn("inferred", F.when(is_empty(F.col("filter")), as_filter(F.col("inferred"))))
        #: query_id, text, normalised, rewritten, variants, filter, inferred
        self.queries = written(asked, "questions")
        self.final = max(most, r["final_top_k"])
        self.lists = self._search(retriever)

    def candidates(self, final: int) -> int:
        """How many hits of each list are looked at for so many that are wanted."""
        re = self.settings["reranker"]
        return max(re["candidates"] if re["enabled"] else final, final)

    def _search(self, retriever: Retriever) -> DataFrame:
        """(query_id, pass, list_no, rank, id, score), written."""
        mode = self.settings["retrieval"]["filter_mode"]
        texts = retrieval_queries(self.queries).join(self.queries.select("query_id", "filter", "inferred"), "query_id")
        main = F.coalesce("inferred", "filter") if mode == "restrict" else F.col("filter")
        passes = [F.struct(F.lit(MAIN).alias("pass"), main.alias("filter"))]
        if mode == "restrict_with_fallback":
            passes.append(F.struct(F.lit(RESTRICTED).alias("pass"), F.col("inferred").alias("filter")))
        each = texts.select("query_id", "list_no", "text", "inferred", F.explode(F.array(*passes)).alias("p")).where(f"p.pass = {MAIN} OR inferred IS NOT NULL")
        named = self.queries.where("filter IS NOT NULL OR inferred IS NOT NULL").limit(1).count() > 0
        flat, hits = worded_lists(retriever, each.select("query_id", "list_no", "text", "p.pass", *(["p.filter"] if named else [])), self.candidates(self.final))
        return written(hits.join(broadcast_if_small(flat.select("wording", "query_id", "pass", "list_no")), "wording").drop("wording"), "lists")

    def _ranked(self, final: int, reranker: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
        """(query_id, pass, rank, id, score, the columns of chunks): fused, without repeats, reranked where that is on."""
        r, re = self.settings["retrieval"], self.settings["reranker"]
        one = F.struct("query_id", "pass").alias("query_id")  # a pass is ranked like a query of its own
        lists = self.lists.where(F.col("rank") <= self.candidates(final)).select(one, "list_no", "rank", "id", "score")
        if self.worded:
            lists = fusion.rrf(lists.withColumn("retriever", F.lit("")), ALL, r["rrf_k"])
        # chunks are read once, for what was found alone
        found = written(broadcast_if_small(lists.select("query_id", "rank", "id", "score")).join(self.chunks, "id"), "found")
        hits = fusion.deduplicate(found, r["dedup_text_similarity"])
        if re["enabled"]:
            passes = F.explode(F.array(F.lit(MAIN), F.lit(RESTRICTED))).alias("pass")
            texts = self.queries.select("query_id", F.coalesce("rewritten", "normalised").alias("text"), passes).select(F.struct("query_id", "pass").alias("query_id"), "text")
            hits = reranker(hits, texts, re["top_k"])
        return hits.select("query_id.query_id", "query_id.pass", "rank", "id", "score", *[c for c in self.chunks.columns if c != "id"])

    def hits(self, final: int = 0, reranker: Callable[[DataFrame, DataFrame, int], DataFrame] = fusion.overlap_rerank) -> DataFrame:
        """(query_id, rank, id, score, the columns of chunks): the best final hits of each question."""
        r = self.settings["retrieval"]
        final = final or r["final_top_k"]
        ranked = self._ranked(final, reranker)
        mode = r["filter_mode"]
        if mode == "restrict_with_fallback":
            keep = [c for c in ranked.columns if c not in ("query_id", "pass", "rank", "id")]
            out = fusion.interleave(ranked.withColumnRenamed("pass", "list_no"), 0, keep)
        elif mode == "boost":
            both = ranked.join(broadcast_if_small(self.queries.select("query_id", "inferred")), "query_id")
            meta = both.withColumn("_m", F.struct(*[F.col(c) if c in both.columns else F.lit(None).cast("date" if c == "publication_date" else "string").alias(c) for c in META]))
            moved = F.col("inferred").isNotNull() & passes_filter("inferred", "_m")
            out = fusion.boost(meta, moved, r["boost_ranks"]).drop("_m", "inferred", "pass")
        else:
            out = ranked.drop("pass")
        return out.where(F.col("rank") <= final)


def contexts(hits: DataFrame, store: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """(query_id, ids, context, token_count, dropped) under the settings' budget."""
    c = settings["context"]
    near = (store, c["neighbor_window"]) if c["neighbor_expansion"] else ()
    return ctx.build(hits, c["max_tokens"], c["max_chunks_per_document"], *near)


def respond(questions: DataFrame, retriever: Retriever, chunks: DataFrame, settings: dict[str, Any], reranker: Callable[[DataFrame, DataFrame, int], DataFrame] = fusion.overlap_rerank, generate: Callable | None = None, model: Callable | None = None, name: str = "extractive", patterns: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, traces) of questions(query_id, text[, filter]): the whole record of each.

    responses: what answer() gives, rewritten, sources (chunk, document, title, authority, section, pages and label of each valid
    citation), retrieved (chunk and score of each hit), prompt_tokens, completion_tokens, cost.  traces: rows of
    streaming.traces.TRACE.  Prices of a million tokens stand under pricing.<name>.input and output.
    """
    from ..streaming import traces

    search = Search(questions, retriever, chunks, settings, model, patterns=patterns)
    hits = written(search.hits(reranker=reranker), "hits")
    built = written(contexts(hits, chunks, settings), "contexts")
    answers = written(answer(hits, search.queries, chunks, settings, generate, built), "answers")
    price = settings["pricing"].get(name, {})
    price = (float(price.get("input", 0.0)), float(price.get("output", 0.0)))
    rows = traces.records(search.queries, hits, built, answers, settings["retrieval"]["type"], name, price=price)
    place = F.struct("id", "document_id", "title", "authority", "section", "page_start", "page_end", grounding.label().alias("label"))
    cited = answers.select("query_id", F.posexplode("citations").alias("at", "id")).join(hits, ["query_id", "id"])
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", place.alias("s")))).alias("s")).select("query_id", F.transform("s", lambda x: x["s"]).alias("sources"))
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score"))).alias("retrieved"))
    usage = rows.select(F.col("request_id").alias("_key"), "prompt_tokens", "completion_tokens", F.col("estimated_cost").alias("cost"))
    out = search.queries.select("query_id", F.col("text").alias("query"), "rewritten", F.col("query_id").cast("string").alias("_key"))
    out = out.join(answers, "query_id").join(sources, "query_id", "left").join(found, "query_id", "left").join(usage, "_key").drop("_key")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    return out.select(*[none(c, kinds[c]) if c in ("sources", "retrieved") else F.col(c) for c in out.columns]), rows


def answer(hits: DataFrame, questions: DataFrame, store: DataFrame, settings: dict[str, Any], generate: Callable[[DataFrame, DataFrame], DataFrame] | None = None, built: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, insufficient, citations, invalid, context_tokens) from ranked hits with their chunk columns.

    store: the chunks; with neighbour expansion their texts and places are read, else their ids alone.  built: contexts(), if there already.

    generate: (shown hits, questions) -> (query_id, answer, cited, insufficient); the extractive model where
    none is given.  Without any context the model isn't asked.
    """
    built = contexts(hits, store, settings) if built is None else built
    shown = hits.join(built.select("query_id", F.explode("ids").alias("id")), ["query_id", "id"], "left_semi")
    asked = questions.join(shown.select("query_id").distinct(), "query_id", "left_semi")
    bare = questions.join(shown.select("query_id").distinct(), "query_id", "left_anti")
    abstained = bare.select("query_id", F.lit(grounding.INSUFFICIENT).alias("answer"), F.lit(None).cast("string").alias("cited"), F.lit(True).alias("insufficient"))
    replies = (generate or grounding.extractive_answers)(shown, asked).select("query_id", "answer", "cited", "insufficient").union(abstained)
    cited = replies.select("query_id", F.when(F.col("cited").isNull(), F.array().cast("array<string>")).otherwise(F.array("cited")).alias("citations"))
    checked = grounding.check_citations(cited, shown, store).groupBy("query_id").agg(F.collect_list(F.when(F.col("valid"), F.col("id"))).alias("citations"), F.collect_list(F.when(~F.col("valid"), F.col("id"))).alias("invalid"))
    out = replies.join(checked, "query_id", "left").join(built.select("query_id", "token_count"), "query_id", "left")
    none = F.array().cast("array<string>")
    shown_answer = grounding.withhold(F.col("answer"), F.col("insufficient"), F.size(F.coalesce("citations", none)))
    return out.select("query_id", shown_answer["answer"].alias("answer"), shown_answer["insufficient"].alias("insufficient"), F.coalesce("citations", none).alias("citations"), F.coalesce("invalid", none).alias("invalid"), F.coalesce("token_count", F.lit(0)).alias("context_tokens"))


def answer_questions(questions: DataFrame, retriever: Retriever, chunks: DataFrame, settings: dict[str, Any], reranker: Callable[[DataFrame, DataFrame, int], DataFrame] = fusion.overlap_rerank, generate: Callable[[DataFrame, DataFrame], DataFrame] | None = None, model: Callable | None = None) -> DataFrame:
    """From questions(query_id, text[, filter]) to answer(): wordings and filters, retrieval, removal of repeats, reranking where that is
    on, contexts, generation.

    chunks: the store, with the columns of a hit; only the chunks that were found are read in full.
    """
    hits = written(Search(questions, retriever, chunks, settings, model).hits(reranker=reranker), "hits")
    return answer(hits, questions, chunks, settings, generate)


def ablation(steps: dict[str, dict], run: Callable[[dict], DataFrame], base: dict) -> DataFrame:
    """Metrics of every step's settings, one row of means each, in one table."""
    from ..operators.metrics import union_all
    from .config import experiment_id, merge

    parts = []
    for i, (name, change) in enumerate(steps.items()):
        config = merge(base, change)
        parts.append(run(config).select(F.lit(i).alias("step"), F.lit(name).alias("name"), F.lit(experiment_id(name, config)).alias("experiment"), "*"))
    return union_all(parts)


def markdown(table: DataFrame) -> str:
    """A small result table as text."""
    rows = [table.columns, ["---"] * len(table.columns), *([str(x) for x in r] for r in table.orderBy("step").collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
