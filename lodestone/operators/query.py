"""Query processing: normalisation, acronym expansion and filter inference."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squash

# Acronyms with their expansions, and the patterns that name a document or an authority.
ACRONYMS = {
    "edd": "enhanced due diligence",
    "cdd": "customer due diligence",
    "pep": "politically exposed person",
    "peps": "politically exposed persons",
    "ubo": "ultimate beneficial owner",
    "ml/tf": "money laundering terrorist financing",
    "kyc": "know your customer",
}
AUTHORITIES = {
    "EBA": r"\b(EBA|European Banking Authority)\b",
    "ECB": r"\b(ECB|European Central Bank)\b",
    "EC": r"\b(European Commission)\b",
    "FATF": r"\b(FATF|Financial Action Task Force)\b",
    "AMLA": r"\b(AMLA|Anti-Money Laundering Authority)\b",
    "ESMA": r"\b(ESMA)\b",
}
DOCUMENTS = {
    "eu_directive_2015_849_amld4": r"\b(Directive\s*\(?EU\)?\s*2015/849|2015/849|AMLD\s*4|4th\s+(AML|Anti-Money Laundering)\s+Directive)\b",
    "eu_regulation_2024_1624_amlr": r"\b(Regulation\s*\(?EU\)?\s*2024/1624|2024/1624|AMLR)\b",
    "fatf_recommendations": r"\b(FATF\s+Recommendations?\s+\d+|Interpretive\s+Note\s+to\s+Recommendation\s+\d+|INR\s*\.?\s*\d+)\b",
    "eba_gl_2022_15_remote_customer_onboarding": r"\b(EBA/GL/2022/15|remote\s+customer\s+onboarding\s+guidelines)\b",
    "eba_gl_2023_04_mltf_risk_access_financial_services": r"\b(EBA/GL/2023/04)\b",
    "eba_ml_tf_risk_factors_gl_2021_02_consolidated": r"\b(EBA/GL/2021/02|ML/TF\s+Risk\s+Factors\s+Guidelines)\b",
}


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(query: Column) -> Column:
    """NFKC, for which the JVM side has no function, then single spaces."""
    return squash(_nfkc(query))


def _named(query: Column, patterns: dict[str, str]) -> Column:
    found = F.array(*[F.when(query.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns.items()])
    return F.filter(found, lambda x: x.isNotNull())


def expand_acronyms(query: Column, acronyms: dict[str, str] = ACRONYMS) -> Column:
    """query with the expansions of its acronyms, in their fixed order, in brackets."""
    quoted = {v: r"(?<!\w)" + k.replace("/", r"\/") + r"(?!\w)" for k, v in acronyms.items()}
    extra = _named(query, quoted)
    return F.when(F.size(extra) == 0, query).otherwise(F.concat(query, F.lit(" ("), F.array_join(extra, "; "), F.lit(")")))


FILTER = "struct<authority: array<string>, document_type: array<string>, document_id: array<string>, gte: date, lte: date>"


def as_filter(inferred: Column) -> Column:
    """An inferred filter as searches take it: without types and dates."""
    none = F.array().cast("array<string>")
    return F.when(inferred.isNotNull(), F.struct(inferred["authority"].alias("authority"), none.alias("document_type"), inferred["document_id"].alias("document_id"), F.lit(None).cast("date").alias("gte"), F.lit(None).cast("date").alias("lte")))


def is_empty(flt: Column) -> Column:
    """Whether a filter restricts nothing; null doesn't."""
    bare = F.lit(True)
    for c in ("authority", "document_type", "document_id"):
        bare &= F.coalesce(F.size(flt[c]) <= 0, F.lit(True))
    return flt.isNull() | (bare & flt["gte"].isNull() & flt["lte"].isNull())


def infer_filter(query: Column, documents: dict[str, str] = DOCUMENTS, authorities: dict[str, str] = AUTHORITIES) -> Column:
    """struct(document_id, authority): named documents, or else named authorities; null where nothing is named."""
    docs, found = _named(query, documents), _named(query, authorities)
    none = F.array().cast("array<string>")
    return F.when((F.size(docs) > 0) | (F.size(found) > 0), F.struct(docs.alias("document_id"), F.when(F.size(docs) > 0, none).otherwise(found).alias("authority")))


def variants(answer: Column, n: int) -> Column:
    """The first n lines of a model's answer, without list marks."""
    lines = F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")
    return F.transform(F.slice(lines, 1, n), lambda x: F.trim(F.regexp_replace(x, r"^[-• ]+|[-• ]+$", "")))


def retrieval_queries(queries: DataFrame) -> DataFrame:
    """(query_id, list_no, text): the rewritten or else normalised query, then its other variants.

    queries: query_id, normalised, rewritten, variants.
    """
    base = F.coalesce("rewritten", "normalised")
    every = F.concat(F.array(base), F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda v: v != base))
    return queries.select("query_id", F.posexplode(every).alias("list_no", "text"))
