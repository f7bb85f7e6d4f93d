"""Retrieval, citation and service metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sized import broadcast_if_small
from ..sources.tables import written
from .intervals import overlapping

KS = (1, 3, 5, 10)
DEPTH = 10


def evidence_units(items: DataFrame) -> DataFrame:
    """(query_id, document_id, page): pages of the evidence, or whole documents (page null) where there is none.

    items: query_id, evidence (array of document_id, pages), documents (array).
    """
    pages = items.where(F.size("evidence") > 0).select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.document_id", F.explode("e.pages").alias("page"))
    whole = items.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select("query_id", F.explode("documents").alias("document_id"), F.lit(None).cast("int").alias("page"))
    return pages.union(whole).distinct()


def cover(hits: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, rank, unit) of each unit (query_id, unit, document_id, page) that a hit's document and pages cover."""
    places = hits.select("query_id", "rank", "document_id", "page_start", "page_end")
    paged = overlapping(places, units.where("page IS NOT NULL").withColumn("_last", F.col("page")), ["query_id", "document_id"], ("page_start", "page_end"), ("page", "_last"))
    return paged.select("query_id", "rank", "unit").union(places.join(units.where("page IS NULL"), ["query_id", "document_id"]).select("query_id", "rank", "unit"))


def relevance(hits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(covered(query_id, rank, unit, counted), sizes(query_id, n_units)) as retrieval_metrics() takes them.

    A hit that an item names by its id covers that id and nothing else; any other hit covers the units of evidence on
    its pages.  An item's units are its evidence, or the ids that it names where it has none; a named hit counts for
    precision, rank and gain beside evidence, but not for recall.
    hits: query_id, rank, id, document_id, page_start, page_end; items: query_id, evidence, documents, ids (array).
    """
    named = items.select("query_id", F.explode(F.array_distinct("ids")).alias("id"))
    units = evidence_units(items).withColumn("unit", F.concat_ws("#", "document_id", F.col("page").cast("string")))
    alone = named.join(units.select("query_id").distinct(), "query_id", "left_anti")
    by_id = hits.join(named, ["query_id", "id"]).join(alone.select("query_id").distinct().withColumn("counted", F.lit(True)), "query_id", "left")
    by_id = by_id.select("query_id", "rank", F.concat(F.lit("id:"), "id").alias("unit"), F.coalesce("counted", F.lit(False)).alias("counted"))
    by_page = cover(hits.join(named, ["query_id", "id"], "left_anti"), units).withColumn("counted", F.lit(True))
    sizes = units.select("query_id", "unit").union(alone.select("query_id", "id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"))
    return by_id.union(by_page), sizes


def retrieval_metrics(covered: DataFrame, queries: DataFrame, sizes: DataFrame, digits: int = 6) -> DataFrame:
    """Recall, precision and hit at KS, MRR and nDCG of every query.

    covered: query_id, rank, unit[, counted]; queries: query_id; sizes: query_id, n_units.  A rank gains in nDCG only
    if it is where some unit is first covered.  Units that aren't counted are left out of recall.
    """
    covered = covered if "counted" in covered.columns else covered.withColumn("counted", F.lit(True))
    units = covered.groupBy("query_id", "unit").agg(F.min("rank").alias("first"), F.bool_or("counted").alias("counted"))
    of_units = units.groupBy("query_id").agg(*[F.count_if((F.col("first") <= k) & F.col("counted")).alias(f"u{k}") for k in KS], F.min("first").alias("best"), F.collect_set(F.when(F.col("first") <= DEPTH, F.col("first"))).alias("gains"))
    ranks = covered.select("query_id", "rank").distinct().groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"r{k}") for k in KS])
    gain = lambda ranks: F.aggregate(F.array_sort(ranks), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    all_ = queries.select("query_id").join(sizes, "query_id", "left").join(of_units, "query_id", "left").join(ranks, "query_id", "left").fillna(0, ["n_units"])
    n = F.col("n_units")
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(DEPTH)), F.lit(1))))
    got = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = []
    for k in KS:
        columns += [F.round(F.when(n > 0, got(f"u{k}") / n).otherwise(0.0), digits).alias(f"recall_{k}"), F.round(got(f"r{k}") / k, digits).alias(f"precision_{k}"), (got(f"r{k}") > 0).cast("double").alias(f"hit_{k}")]
    mrr = F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), digits).alias("mrr")
    ndcg = F.round(F.when(n > 0, F.coalesce(gain(F.col("gains")), F.lit(0.0)) / ideal).otherwise(0.0), digits).alias("ndcg_10")
    return all_.select("query_id", *columns, mrr, ndcg)


def citation_metrics(citations: DataFrame, items: DataFrame, digits: int = 6) -> DataFrame:
    """Correctness, completeness and invalid rate of each answer's citations.

    citations: query_id, id, document_id, valid, relevant; items: query_id, answerable, documents.
    Unanswerable items have an invalid rate only.
    """
    found = citations.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("v"), F.count_if(F.col("valid") & F.col("relevant")).alias("r"), F.collect_set(F.when(F.col("valid"), F.col("document_id"))).alias("d")
    )
    all_ = items.join(found, "query_id", "left").fillna(0, ["n", "v", "r"])
    want = F.size(F.array_distinct("documents"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), digits)
    both = F.coalesce(F.size(F.array_intersect("documents", "d")), F.lit(0))
    return all_.select(
        "query_id", F.when(F.col("answerable"), share(F.col("r"), F.col("v"))).alias("citation_correctness"),
        F.when(F.col("answerable"), share(F.greatest(both, F.lit(0)), want)).alias("citation_completeness"), share(F.col("n") - F.col("v"), F.col("n")).alias("invalid_citation_rate"),
    )


def answerability(answerable: Column, insufficient: Column) -> tuple[Column, Column]:
    """(answerable_success, abstention_accuracy), each null where the other applies."""
    return F.when(answerable, (~insufficient).cast("double")), F.when(~answerable, insufficient.cast("double"))


def means(rows: DataFrame, columns: list[str], by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Means over the rows that have a value, for every group and, where by is given, for all (group null)."""
    aggs = [F.round(F.avg(c), digits).alias(c) for c in columns] + [F.count(F.lit(1)).alias("n")]
    return rows.groupBy().agg(*aggs) if not by else rows.rollup(*by).agg(*aggs)


def quantile_exclusive(values: Column, percent: int) -> Column:
    """The percent-th of 99 exclusive cut points of an array; a single value is its own quantile, outer ones extrapolate."""
    v, n = F.array_sort(values), F.size(values)
    at = F.least(F.greatest(F.floor((n + 1) * percent / 100).cast("int"), F.lit(1)), n - 1)
    rest = (n + 1) * percent - at * 100
    cut = (F.element_at(v, at) * (100 - rest) + F.element_at(v, at + 1) * rest) / 100
    return F.when(n == 0, None).when(n == 1, F.element_at(v, F.when(n >= 1, 1))).otherwise(F.when(n > 1, cut))


def exact_quantiles(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95), digits: int = 6) -> DataFrame:
    """Exclusive quantiles of large groups, without an array or one task for a group: only the two neighbours of each cut are
    looked up by rank.

    Equal values are counted before they are ranked.  The distinct ones are dealt into bins by range, in a table that is written
    once; ranks are sums over whole bins and running sums inside one.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts.repartitionByRange(by, "v").withColumn("bin", F.spark_partition_id()), "bins")
    of_bin = counts.groupBy(by, "bin").agg(F.sum("c").alias("s"))
    whole = Window.partitionBy(by)
    of_bin = of_bin.select(by, "bin", F.coalesce(F.sum("s").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(whole).alias("n"))
    inside = Window.partitionBy(by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(broadcast_if_small(of_bin), [by, "bin"]).withColumn("past", F.col("before") + F.sum("c").over(inside))
    n = F.col("n")
    out = []
    for p in percents:
        at = F.least(F.greatest(F.floor((n + 1) * p / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))
        rest = (n + 1) * p - at * 100
        pick = lambda r: F.max(F.when((F.col("past") >= r) & (F.col("past") - F.col("c") < r), F.col("v")))
        out += [pick(at).alias(f"a{p}"), pick(at + 1).alias(f"b{p}"), F.max(rest).alias(f"w{p}")]
    found = ranked.groupBy(by).agg(F.max("n").alias("n"), *out)
    cut = lambda p: F.when(F.col("n") == 1, F.col(f"a{p}")).otherwise((F.col(f"a{p}") * (100 - F.col(f"w{p}")) + F.col(f"b{p}") * F.col(f"w{p}")) / 100)
    return found.select(by, "n", *[F.round(cut(p), digits).alias(f"p{p}") for p in percents])


def service_percentile(values: Column, q: float) -> Column:
    """The value at the half-even rounded index q * (n - 1) of an array; 0 if there is none."""
    n = F.size(values)
    return F.when(n == 0, 0.0).otherwise(F.element_at(F.array_sort(values), F.greatest(F.bround(q * (n - 1), 0).cast("int"), F.lit(0)) + 1))


def cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    """Prices are for a million tokens; without a price the cost is 0."""
    return F.coalesce((prompt * input_price + completion * output_price) / 1_000_000, F.lit(0.0))


def latest(rows: DataFrame, by: str, order: list[str], n: int = 1000) -> DataFrame:
    """The n latest rows of each group: the window of service metrics."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
