"""Service metrics over the append-only trace table, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count


TRACE = (
    "request_id string, timestamp timestamp, query string, rewritten_query string, variants array<string>, retrieval_strategy string, retrieved_chunk_ids array<string>, "
    "retrieval_scores array<double>, context_chunk_ids array<string>, prompt_tokens int, completion_tokens int, estimated_cost double, model string, prompt_version string, "
    "invalid_citations array<string>, insufficient_evidence boolean, errors array<string>"
)


def records(questions: DataFrame, hits: DataFrame, context: DataFrame, answers: DataFrame, strategy: str, model: str = "extractive", prompt_version: str = "v1", price: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """TRACE rows of answered questions, one of each; append them with stores.write_jsonl(..., append=True).

    questions: query_id, text[, rewritten, variants]; hits: query_id, rank, id, score; context: query_id, ids, context;
    answers: query_id, answer, insufficient, invalid.  price: of a million tokens in and out.
    """
    optional = lambda c, kind: F.col(c) if c in questions.columns else F.lit(None).cast(kind)
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("h"))
    shown = context.select("query_id", F.col("ids").alias("context_chunk_ids"), token_count(F.col("context")).alias("prompt_tokens"))
    rows = questions.select("query_id", "text", optional("rewritten", "string").alias("rewritten_query"), optional("variants", "array<string>").alias("variants"))
    rows = rows.join(found, "query_id", "left").join(shown, "query_id", "left").join(answers, "query_id", "left")
    none = F.array().cast("array<string>")
    tokens = {"prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)), "completion_tokens": F.coalesce(token_count(F.col("answer")), F.lit(0))}
    rows = rows.withColumns(tokens)
    return rows.select(
        F.col("query_id").cast("string").alias("request_id"), F.current_timestamp().alias("timestamp"), F.col("text").alias("query"), "rewritten_query", F.coalesce("variants", none).alias("variants"), F.lit(strategy).alias("retrieval_strategy"),
        F.coalesce(F.transform("h", lambda x: x["id"]), none).alias("retrieved_chunk_ids"), F.coalesce(F.transform("h", lambda x: x["score"]), F.array().cast("array<double>")).alias("retrieval_scores"),
        F.coalesce("context_chunk_ids", none).alias("context_chunk_ids"), "prompt_tokens", "completion_tokens", ((F.col("prompt_tokens") * price[0] + F.col("completion_tokens") * price[1]) / 1_000_000).alias("estimated_cost"),
        F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.coalesce("invalid", none).alias("invalid_citations"), F.coalesce("insufficient", F.lit(True)).alias("insufficient_evidence"), none.alias("errors"),
    )


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed(traces: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, by, requests, mean, worst) for tumbling windows; batch and streaming alike."""
    rows = traces.withWatermark(time, late) if traces.isStreaming else traces
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("worst"))
    return out.select(F.col("w.start").alias("window_start"), by, "requests", "mean", "worst")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append finished windows to a Parquet table, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
