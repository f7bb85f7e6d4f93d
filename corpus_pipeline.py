"""Raw documents to token ids: language ID, exact dedup, near-duplicate join, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of docs, whatever these are called.

Defined results, of all stages.  An empty table gives an empty table.  Null ids and ids that repeat are rows like any other.
Very long texts are handled whole.  What a stage says of null and empty texts, of ties and of rows that repeat stands
with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.sized import broadcast_if_small
from lodestone.llm import decontam, exact_dedup, langid, ngram_join, sentencepiece_codec
from lodestone.llm.store import discard, materialize, scratch


def _columns_apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage sees the text, the key and the language by their names and every other column by a number."""
    own = {c: c if c in ("doc_id", "text", "lang") else f"_c{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject.  A null text and a text without a letter are rejected; a text on
    the limit stays.  Rows that repeat stay or go together.  Where no row has a language and a text, nothing is known and all go."""
    model = langid.train(docs, F.lit(True))
    return _columns_apart(docs, lambda d: langid.identify(d, model).where("NOT rejected"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is smaller than any other.  Null counts as an empty text.  Of
    rows that repeat text and id, one stays."""
    return _columns_apart(docs, exact_dedup.distinct_texts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 on five-word shingles join, the one with the smallest id.

    Documents without words (null, empty, blank) link with nothing and all stay.  A null id is larger than any other; of rows that
    tie, the one that was numbered first stays.
    """

    def one_of_each(d: DataFrame) -> DataFrame:
        # rows and not ids are the nodes: ids may be null or repeat.  Written, so that a row has one number.
        rows = materialize(d.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = ngram_join.ngram_join(rows, key="_row", n=5, num=80, den=100, count_links=False)
        ids = materialize(rows.select("_row", "doc_id").join(found, "_row"), "grouped")
        stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("x")
        first = ids.groupBy("component_id").agg(stays, F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("x._row").alias("stays"))
        dropped = materialize(ids.join(first, "component_id").where("_row <> stays").select("_row"), "dropped")
        # numbers of the rows that go move, texts don't, as long as these are few enough
        return rows.join(broadcast_if_small(dropped, exact_dedup.MOST_DROPPED), "_row", "left_anti").drop("_row")

    return _columns_apart(docs, one_of_each)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages.  A document without words is clean; one whose hit words are
    exactly a twentieth goes.  Rows that repeat stay or go together."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns_apart(docs, lambda d: decontam.judge(decontam.contamination(d, bench)).where("NOT contaminated"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, and whether they decode to the text again.  Null is encoded as an empty text, which has no ids.  Rows that repeat
    are encoded each."""
    own = docs.select("doc_id", "lang", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(own, carry=["doc_id", "lang", "source", "_h"]))
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.xxhash64("decoded") == F.col("_h")).alias("round_trip"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("sentencepiece", encoding)]

#: Language models and piece encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(after)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
