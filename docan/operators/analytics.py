"""Statistics of job records over periods, buckets, tenants and workers.

Every function takes a frame of records and column names; the moment that counts as now is always a
parameter. All are one aggregation with map-side combine, or one per window; breakdowns by several
dimensions are one pass with grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docan.functions.numbers import percentile_linear, ratio


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (ties must be broken by the order itself)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def measures(ok: Column, failed: Column, pages: Column, seconds: Column) -> list[Column]:
    """Counts, pages and positive durations of a group of records."""
    positive = F.when(seconds > 0, seconds)
    return [
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(pages), F.lit(0)).cast("long").alias("pages"),
        F.round(F.coalesce(F.avg(positive), F.lit(0.0)), 6).alias("avg_seconds"),
        F.round(F.coalesce(percentile_linear(positive, 0.5), F.lit(0.0)), 6).alias("p50_seconds"),
        F.round(F.coalesce(percentile_linear(positive, 0.95), F.lit(0.0)), 6).alias("p95_seconds"),
        F.round(ratio(F.count_if(ok), F.count(F.lit(1))), 6).alias("success_rate"),
    ]


def within(ts: Column, start: str, end: str) -> Column:
    """Half-open period [start, end)."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def series(rows: DataFrame, ts: str, start: str, end: str, seconds: int, aggregates: Sequence[Column]) -> DataFrame:
    """One row per bucket of ``seconds`` from ``start``; the last ends at ``end``; empty buckets are there with zeros."""
    spark = rows.sparkSession
    a, b = F.unix_seconds(F.lit(start).cast("timestamp")), F.unix_seconds(F.lit(end).cast("timestamp"))
    buckets = spark.range(1).select(F.explode(F.sequence(a, b - 1, F.lit(seconds).cast("long"))).alias("from_s"))
    own = rows.filter(within(F.col(ts), start, end)).withColumn("from_s", a + F.floor((F.unix_micros(F.col(ts)) / 1e6 - a) / seconds) * seconds)
    found = own.groupBy("from_s").agg(*aggregates)
    names = [c for c in found.columns if c != "from_s"]
    # the calendar is as long as the period has buckets, not as the data
    joined = buckets.join(found, "from_s", "left")
    until = F.timestamp_seconds(F.least(F.col("from_s") + seconds, b))
    return joined.select(F.timestamp_seconds("from_s").alias("bucket_start"), until.alias("bucket_end"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def breakdown(rows: DataFrame, dimensions: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """(dimension, value, ...) for several dimensions in one pass over the rows; blank values are left out."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = rows.groupingSets(sets, *(F.col(d) for d in dimensions)).agg(F.grouping_id().alias("__set"), *aggregates)
    all_set = 2 ** len(dimensions) - 1
    name = F.coalesce(*(F.when(F.col("__set") == all_set - 2 ** (len(dimensions) - 1 - i), F.lit(d)) for i, d in enumerate(dimensions)))
    value = F.coalesce(*(F.col(d).cast("string") for d in dimensions))
    return grouped.select(name.alias("dimension"), value.alias("value"), *(c for c in grouped.columns if c not in (*dimensions, "__set"))).filter("value <> ''")


def change(now: Column, before: Column) -> Column:
    """Percentage change; 0 where there was nothing before."""
    return F.round(F.when(before > 0, (now - before) / before * 100).otherwise(0.0), 4)


def cumulative_histogram(rows: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, bound, at_most): counts up to each bound; the bound is null for all."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(F.lit(1)).alias("all"))
    parts = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("at_most")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("bound"), F.col("all").alias("at_most"))]
    return counts.select(*keys, F.inline(F.array(*parts)))


def hours(rows: DataFrame, ts: str, aggregates: Sequence[Column]) -> DataFrame:
    """All 24 hours of the day with their aggregates, zero where no row falls in."""
    found = rows.groupBy(F.hour(ts).cast("long").alias("hour")).agg(*aggregates)
    every = rows.sparkSession.range(24).withColumnRenamed("id", "hour")
    return every.join(found, "hour", "left").select("hour", *(F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != "hour"))


def outliers(groups: DataFrame, value: str, sigma: float = 2.0, least: int = 3) -> DataFrame:
    """Rows of a table of groups whose value is more than ``sigma`` sample deviations from the mean.

    The statistics come from a plain aggregate joined back, not from a window over everything.
    """
    stats = groups.agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    z = (F.col(value) - F.col("__mean")) / F.col("__sd")
    return groups.crossJoin(F.broadcast(stats)).filter((F.col("__n") >= least) & (F.col("__sd") > 0)).withColumn("z", z).filter(F.abs("z") > sigma).drop("__n", "__mean", "__sd")  # stats is one row
