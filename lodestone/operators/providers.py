"""Models behind functions: rerankers, embedders, chat models and judges, called on Arrow batches.

Each hook takes a plain function from a list to a list, which an executor calls batch by batch; a failed
call is tried again with growing pauses if the error looks transient.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from ..sources.tables import written

# Replies of a service that are worth another try.
TRANSIENT = (408, 409, 429, 500, 502, 503, 504)
CONTEXT_CHARS = 12_000


def retried(call: Callable[..., Any], attempts: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """call, again after errors without a status (connections) or with a transient one."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001
                status = getattr(e, "status", getattr(e, "code", None))
                if i + 1 == attempts or (status is not None and status not in TRANSIENT):
                    raise
                sleep(pause * 2**i * (1 + random.random()))

    return run


def _apply(df: DataFrame, columns: list[str], out: str, kind: str, call: Callable[[list], list], batch: int) -> DataFrame:
    safe = retried(call)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values: list = []
            for i in range(0, len(part), batch):
                rows = part[columns].iloc[i : i + batch]
                values += safe(list(rows.itertuples(index=False, name=None)) if len(columns) > 1 else rows[columns[0]].tolist())
            yield part.assign(**{out: values})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out) + f", `{out}` {kind}"
    return df.drop(out).mapInPandas(run, schema)


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", prefix: str = "", batch: int = 64) -> DataFrame:
    """df with vector: model of the prefixed texts."""
    return _apply(df.withColumn("_in", F.concat(F.lit(prefix), F.col(text))), ["_in"], "vector", "array<double>", model, batch).drop("_in")


def rerank(hits: DataFrame, queries: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], k: int, batch: int = 32) -> DataFrame:
    """hits(query_id, rank, id, text, score) by the model's score of (query, text); the old score stays as pre_rerank_score."""
    both = hits.withColumnRenamed("score", "pre_rerank_score").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = _apply(both, ["_q", "text"], "score", "double", model, batch).drop("_q")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("_new", F.row_number().over(w)).where(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")


def generate(prompts: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]], batch: int = 8) -> DataFrame:
    """prompts(system, user, ...) with reply."""
    return _apply(prompts, ["system", "user"], "reply", "string", model, batch)


SCORES = ("faithfulness", "answer_relevance", "context_relevance")


def judgements(reply: Column) -> Column:
    """Scores of a judge's JSON reply by name; null where it isn't JSON, lacks one, or one lies outside 0 to 1."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "map<string, double>")
    whole = F.forall(F.array(*[F.lit(n) for n in SCORES]), lambda n: F.coalesce(F.try_element_at(found, n).between(0.0, 1.0), F.lit(False)))
    return F.when(whole, F.map_filter(found, lambda k, v: k.isin(*SCORES)))


JUDGE = "You grade answers strictly and evenly."
REWRITER = "You word search queries."


def judge_prompt(question: Column, answer: Column, context: Column) -> Column:
    asked = F.lit("Grade the ANSWER by the EVIDENCE. Reply as JSON with numbers from 0 to 1: " + ", ".join(SCORES) + ".\nEVIDENCE:\n")
    return F.concat(asked, judged_context(context), F.lit("\nQUESTION: "), question, F.lit("\nANSWER: "), answer)


def judge(rows: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]]) -> DataFrame:
    """rows(question, answer, context, ...) with judge_<name> of each score: estimates of a model, not ground truth."""
    asked = rows.withColumns({"system": F.lit(JUDGE), "user": judge_prompt(F.col("question"), F.col("answer"), F.col("context"))})
    found = generate(asked, model).withColumn("_j", judgements(F.col("reply")))
    return found.select(*rows.columns, *[F.try_element_at("_j", F.lit(n)).alias(f"judge_{n}") for n in SCORES])


def asked_once(prompts: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]]) -> DataFrame:
    """prompts(system, user, ...) with reply.  Each different prompt goes to the model once: the replies are a written ledger that
    every later plan reads, so that none of them asks again."""
    asked = prompts.select("system", "user").distinct()
    ledger = written(generate(asked, model), "replies")
    return prompts.join(broadcast_if_small(ledger), ["system", "user"])


def reworded(queries: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]], rewriting: bool = True, n: int = 0) -> DataFrame:
    """queries(query_id, normalised, ...) with rewritten and variants, as query.retrieval_queries() takes them.

    rewriting asks for one better wording, n for so many others; what isn't asked for is null.  The model is asked once for each
    different prompt.
    """
    from .query import variants

    better = F.concat(F.lit("Word this for a search in legal texts, keep all numbers, reply with the query alone:\n"), "normalised")
    others = F.concat(F.lit(f"Give {n} different search queries for this, one a line:\n"), "normalised")
    kinds = [F.struct(F.lit(kind).alias("kind"), user.alias("user")) for kind, user, on in (("rewritten", better, rewriting), ("variants", others, n > 0)) if on]
    bare = queries.drop("rewritten", "variants")
    if not kinds:
        return bare.withColumns({"rewritten": F.lit(None).cast("string"), "variants": F.lit(None).cast("array<string>")})
    prompts = bare.select("normalised").where("normalised IS NOT NULL").distinct().select("normalised", F.explode(F.array(*kinds)).alias("p")).select("normalised", "p.kind", F.lit(REWRITER).alias("system"), "p.user")
    said = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("reply")))
    replies = asked_once(prompts, model).groupBy("normalised").agg(said("rewritten").alias("_r"), said("variants").alias("_v"))
    text = F.regexp_replace(F.trim("_r"), '^"+|"+$', "")
    out = bare.join(replies, "normalised", "left")
    return out.withColumns({"rewritten": F.nullif(text, F.lit("")), "variants": variants(F.col("_v"), n)}).select(*bare.columns, "rewritten", "variants")


def generate_cached(prompts: DataFrame, cache: DataFrame, name: str, model: Callable[[list[tuple[str, str]]], list[str]], json_mode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(prompts(system, user, ...) with reply, new cache entries(key, reply)): the model is asked once for each prompt that the cache lacks."""
    from ..sources.stores import reply_key

    keyed = prompts.withColumn("key", reply_key(F.lit(name), F.lit(json_mode), F.col("system"), F.col("user")))
    missing = keyed.select("key", "system", "user").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = generate(missing, model).select("key", "reply")
    return keyed.join(cache.select("key", "reply").unionByName(fresh), "key", "left").drop("key"), fresh


# What the families of embedding models want before queries and documents.
PREFIXES = {"e5": ("query: ", "passage: "), "bge-en": ("Represent this sentence for searching relevant passages: ", "")}


def prefixes(model: str) -> tuple[str, str]:
    """What stands before a query and before a document for a model of that name."""
    name = model.lower()
    family = "e5" if "e5" in name else "bge-en" if "bge" in name and "en" in name else ""
    return PREFIXES.get(family, ("", ""))


_loaded: dict[str, Any] = {}


def load_once(name: str, make: Callable[[], Any]) -> Any:
    """A model of that name, made once in each worker and kept for its later batches."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def embedder(provider: str, model: str = "", make: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> Callable[[DataFrame, str, Column, bool], DataFrame]:
    """embed(df, id, text, is_query) -> (id, vector) of a provider: hashing, or any other whose model make() loads in a worker."""
    from .dense import hashed_vectors

    if provider == "hashing":
        return lambda df, id_, text, is_query=False: hashed_vectors(df, id_, text)
    if make is None:
        raise ValueError(f"unknown embedding provider {provider}")
    before = prefixes(model)

    def run(df: DataFrame, id_: str, text: Column, is_query: bool = False) -> DataFrame:
        rows = df.select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        return embed(rows, lambda texts: load_once(f"{provider}/{model}", make)(texts), prefix=before[0 if is_query else 1]).select("id", "vector")

    return run


def judged_context(context: Column) -> Column:
    return F.substring(context, 1, CONTEXT_CHARS)


REQUEST = "query string, top_k int, debug boolean, filters struct<authority: array<string>, document_type: array<string>, publication_date_gte: date, publication_date_lte: date>"


def parse_requests(bodies: DataFrame, authorities: tuple[str, ...]) -> DataFrame:
    """bodies(body, ...) with the fields of their JSON and problem: null for a valid request."""
    names = [x.split()[0] for x in ("query string", "top_k int", "debug boolean", "filters struct")]
    inner = ("authority", "document_type", "publication_date_gte", "publication_date_lte")
    parsed = bodies.withColumn("_r", F.from_json("body", REQUEST, {"mode": "PERMISSIVE"}))
    unknown = lambda keys, known: F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))) > 0
    extra = unknown(F.json_object_keys("body"), names) | unknown(F.json_object_keys(F.get_json_object("body", "$.filters")), inner)
    flat = parsed.withColumns({"query": F.trim("_r.query"), "top_k": F.col("_r.top_k"), "debug": F.coalesce("_r.debug", F.lit(False)), "filters": F.col("_r.filters"), "authority": F.col("_r.filters.authority")})
    checked = check_requests(flat, authorities)
    not_json = F.json_object_keys("body").isNull()
    return checked.withColumn("problem", F.when(not_json, "not a JSON object").when(extra, "unknown field").otherwise(F.col("problem"))).drop("_r", "authority")


def check_requests(requests: DataFrame, authorities: tuple[str, ...]) -> DataFrame:
    """requests(query, top_k, authority) with problem: null for a valid one."""
    n = F.length(F.trim("query"))
    unknown = F.size(F.array_except(F.coalesce("authority", F.array().cast("array<string>")), F.array(*[F.lit(a) for a in authorities]))) > 0
    problem = F.when(F.coalesce(n, F.lit(0)) < 3, "query too short").when(F.length("query") > 1000, "query too long").when(~F.coalesce("top_k", F.lit(1)).between(1, 50), "top_k out of range").when(unknown, "unknown authority")
    return requests.withColumn("problem", problem)
