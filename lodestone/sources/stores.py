"""Chunk, vector, cache, trace and evaluation-set tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, point_id
from .snapshots import Snapshots

CHUNK_SCHEMA = (
    "chunk_id string, document_id string, text string, title string, authority string, document_type string, section string, page_start int, page_end int, "
    "publication_date date, source_url string, chunking_strategy string, token_count int, position int, parent_id string, parent_text string"
)
EVAL_SCHEMA = (
    "id string, question string, answerable boolean, question_type string, relevant_document_ids array<string>, "
    "relevant_evidence array<struct<document_id string, pages array<int>>>, relevant_chunk_ids array<string>, reference_answer string, tags array<string>, difficulty string, validated boolean"
)
# Kinds of questions.
QUESTION_TYPES = ("factual", "multi_section", "cross_document", "terminology", "exact_reference", "ambiguous", "unanswerable", "adversarial")
DIFFICULTIES = ("easy", "medium", "hard")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def eval_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems(id, problem)): documents follow from the evidence; answerable items need some ground truth; ids are unique; kinds and
    difficulties are known ones, factual and medium where none is given."""
    raw = read_jsonl(spark, path, EVAL_SCHEMA).withColumns({"answerable": F.coalesce("answerable", F.lit(True)), "question_type": F.coalesce("question_type", F.lit("factual")), "difficulty": F.coalesce("difficulty", F.lit("medium"))})
    named = F.array_sort(F.array_distinct(F.transform("relevant_evidence", lambda e: e["document_id"])))
    none = F.array().cast("array<string>")
    items = raw.withColumn("relevant_document_ids", F.when(F.coalesce(F.size("relevant_document_ids"), F.lit(0)) > 0, F.col("relevant_document_ids")).otherwise(F.coalesce(named, none)))
    bare = F.col("answerable") & (F.size("relevant_document_ids") <= 0) & (F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) <= 0)
    twice = items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    wrong = lambda on, what: items.where(on).select("id", F.lit(what).alias("problem"))
    problems = [wrong(bare, "answerable without ground truth"), wrong(~F.col("question_type").isin(*QUESTION_TYPES), "unknown question type"), wrong(~F.col("difficulty").isin(*DIFFICULTIES), "unknown difficulty")]
    return items, problems[0].union(problems[1]).union(problems[2]).union(twice)


def documents(chunks: DataFrame) -> DataFrame:
    """One row per document: chunks, last page, and the attributes of its first chunk."""
    first = [F.min_by(c, "position").alias(c) for c in ("title", "authority", "document_type", "publication_date") if c in chunks.columns]
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("page_end").alias("pages"), *first)


def collection_name(prefix: str, strategy: str, model: str, version: int = 1, contextual: bool = False) -> str:
    import re

    return re.sub("[^a-z0-9_]+", "_", f"{prefix}_{strategy}_{model}{'_ctx' if contextual else ''}_v{version}".lower())


class VectorTable:
    """A collection of vectors keyed by point id, in versions: the last batch that has an id wins.

    Writers at the same time each keep their batch; a reader sees the version that was current when it began, and the files of the
    version before the current one stay for such readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Snapshots(spark, path)

    def recreate(self, rows: DataFrame) -> int:
        """A version of these rows alone: chunk_id, vector and any payload.  They may be read from this collection."""
        batch = self._write(rows)
        version = self.versions.commit(lambda old: [batch])
        self.versions.expire()
        return version

    def upsert(self, rows: DataFrame) -> int:
        """A version with a further batch.  Of rows of one id in a batch, one stays, the same in every read."""
        batch = self._write(rows)
        return self.versions.commit(lambda old: [*old, batch])

    def compact(self) -> int:
        """A version of the same rows in one batch, which reads without a shuffle.  Changed is raised if others wrote meanwhile."""
        version, _ = self.versions.entries()
        batch = self._write(self.scan(version))
        return self.versions.commit(lambda old: [batch], version)

    def _write(self, rows: DataFrame) -> dict:
        made = rows.drop("point_id").withColumn("point_id", point_id(F.col("chunk_id")))
        one = Window.partitionBy("point_id").orderBy(F.xxhash64(*made.columns))
        name = self.versions.new_name()
        made.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").write.parquet(self.versions.batch(name))
        return {"name": name}

    def scan(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one if none is named."""
        _, entries = self.versions.entries(version)
        if not entries:
            raise ValueError(f"{self.versions.path}: no version was committed")
        paths = [self.versions.batch(e["name"]) for e in entries]
        if len(paths) == 1:
            return self.spark.read.parquet(*paths)
        rows = self.spark.read.option("basePath", f"{self.versions.path}/data").option("mergeSchema", "true").parquet(*paths)
        order = self.spark.createDataFrame([(e["name"], i) for i, e in enumerate(entries)], "batch string, _order int")
        return last_write(rows.join(F.broadcast(order), "batch"), "point_id", "_order").drop("batch", "_order")

    def count(self, version: int | None = None) -> int:
        return self.scan(version).select("point_id").count()

    def healthy(self) -> bool:
        return bool(self.versions.entries()[1])


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cached(rows: DataFrame, cache: DataFrame, model: str, text: str, compute) -> tuple[DataFrame, DataFrame]:
    """(rows with value, new cache entries): only texts that the cache(key, value) lacks are computed, each once.

    compute: DataFrame(key, text) -> DataFrame(key, value).
    """
    keyed = rows.withColumn("key", cache_key(F.lit(model), F.col(text)))
    missing = keyed.select("key", F.col(text).alias("text")).join(cache, "key", "left_anti").dropDuplicates(["key"])
    fresh = compute(missing)
    return keyed.join(cache.unionByName(fresh), "key", "left").drop("key"), fresh


def reply_key(model: Column, json_mode: Column, system: Column, user: Column) -> Column:
    """Cache key of a model reply."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(model, nul, F.initcap(json_mode.cast("string")), nul, system, nul, user), 256)


def contextual_ids(df: DataFrame, document: str, strategy: str) -> DataFrame:
    """df(position) with chunk and point ids."""
    cid = F.format_string("%s:%s:%05d", F.col(document), F.lit(strategy), F.col("position"))
    return df.withColumn("chunk_id", cid).withColumn("point_id", point_id(cid))
