"""Answers and their citations: extraction, parsing, validation and withholding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from ..functions.text import strip
from .context import pages_label

# The message of an abstention, and the remark on a withheld answer.
INSUFFICIENT = "The provided documents do not contain sufficient information to answer this question reliably."
WITHHELD = " (The model's draft answer had no valid citations and was withheld.)"
LEAST_OVERLAP = 0.3
ANSWER_CHARS = 400


def content_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def extractive_answers(hits: DataFrame, questions: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, answer, cited, insufficient): the first sentence of the block that shares most content words.

    The first of equal blocks wins; below LEAST_OVERLAP of the question's words the answer is an abstention.
    """
    q = questions.select("query_id", content_words(F.col("text")).alias("q"))
    share = F.round(F.size(F.array_intersect("q", content_words(F.col("text")))) / F.greatest(F.size("q"), F.lit(1)), digits)
    scored = hits.select("query_id", "rank", "id", "text").join(q, "query_id").withColumn("share", share)
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("share"), "rank"))).where("n = 1")
    enough = (F.col("share") >= LEAST_OVERLAP) & (F.col("share") > 0)
    first = F.substring(F.element_at(F.split(strip(F.col("text")), r"(?<=[.;])\s"), 1), 1, ANSWER_CHARS)
    found = best.select("query_id", F.when(enough, first).alias("answer"), F.when(enough, F.col("id")).alias("cited"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(INSUFFICIENT)).alias("answer"), "cited", F.col("cited").isNull().alias("insufficient"))


_ANSWER = "answer string, citations array<struct<chunk_id string>>, insufficient_evidence boolean"


def _valid(raw: Column) -> Column:
    """The answer in a JSON text, or null unless every part has its own type."""
    parsed = F.from_json(raw, _ANSWER, {"mode": "PERMISSIVE"})
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    present = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    text_ok = F.coalesce(kind("$.answer") == "STRING", F.lit(False))
    flag_ok = ~present("$.insufficient_evidence") | F.coalesce(kind("$.insufficient_evidence") == "BOOLEAN", F.lit(False))
    list_ok = ~present("$.citations") | F.coalesce(kind("$.citations").startswith("ARRAY") & parsed["citations"].isNotNull() & F.forall(parsed["citations"], lambda c: F.coalesce(c["chunk_id"].isNotNull(), F.lit(False))), F.lit(False))
    none = F.array().cast("array<struct<chunk_id string>>")
    whole = F.struct(parsed["answer"].alias("answer"), F.transform(F.coalesce(parsed["citations"], none), lambda c: c["chunk_id"]).alias("citations"), F.coalesce(parsed["insufficient_evidence"], F.lit(False)).alias("insufficient_evidence"))
    return F.when(text_ok & flag_ok & list_ok, whole)


def parse_answer(raw: Column) -> Column:
    """struct(answer, citations, insufficient_evidence) of a model's reply: without code fences, else its outermost braces, else an abstention."""
    bare = F.trim(F.regexp_replace(strip(raw), r"(?m)^```(json)?|```$", ""))
    braces = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    abstain = F.struct(F.lit(INSUFFICIENT).alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit(True).alias("insufficient_evidence"))
    return F.coalesce(_valid(bare), _valid(braces), abstain)


def label() -> Column:
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(", §"), F.col("section"))).otherwise("")
    return F.concat(F.lit("["), "authority", F.lit(" — "), "title", section, F.lit(", "), pages_label(F.col("page_start"), F.col("page_end")), F.lit("]"))


def check_citations(answers: DataFrame, context: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(query_id, ord, id, valid): each answer's distinct citations, valid if shown to the model and, where given, in the store.

    answers: query_id, citations (array of ids); context: query_id, id; store: id.
    """
    cited = answers.select("query_id", F.posexplode("citations").alias("ord", "id")).withColumn("id", F.trim("id")).groupBy("query_id", "id").agg(F.min("ord").alias("ord"))
    shown = context.select("query_id", "id").distinct().withColumn("_in", F.lit(True))
    out = cited.join(shown, ["query_id", "id"], "left")
    ok = F.col("_in").isNotNull()
    if store is not None:
        there = store.select("id").join(broadcast_if_small(cited.select("id").distinct()), "id", "left_semi").distinct()
        out = out.join(there.withColumn("_there", F.lit(True)), "id", "left")
        ok &= F.col("_there").isNotNull()
    return out.select("query_id", "ord", "id", ok.alias("valid"))


def coverage(answer: Column, valid: Column) -> Column:
    """Share of longer sentences with a [n] mark; 1 for a single sentence with a valid citation."""
    long = F.filter(F.split(strip(answer), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 20)
    marked = F.size(F.filter(long, lambda s: s.rlike(r"\[\d+\]")))
    return F.when(F.size(long) == 0, 0.0).when((valid > 0) & (F.size(long) == 1), 1.0).otherwise(marked / F.size(long))


def withhold(answer: Column, insufficient: Column, valid: Column) -> Column:
    """struct(answer, insufficient): an answer without a valid citation isn't shown."""
    bare = (valid == 0) & ~insufficient
    return F.struct(F.when(bare, F.lit(INSUFFICIENT + WITHHELD)).otherwise(answer).alias("answer"), (insufficient | (bare & (answer != ""))).alias("insufficient"))
