"""Statistics over job records, events and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docan.functions.numbers import coefficient_of_variation, percentile_floor_index, percentile_linear, percentile_nearest_rank, ratio
from docan.operators import analytics as a
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()
q = registry.query

START, MIDDLE, END = "2025-04-01 00:00:00", "2025-08-01 00:00:00", "2025-12-01 00:00:00"
_JOBS = """WITH job AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(job_id)) ORDER BY loaded_at DESC NULLS LAST, created_at DESC NULLS LAST, status) AS rn FROM jobs) WHERE rn = 1
)"""
_MEASURES = """count(*) AS jobs, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  coalesce(sum(total_pages), 0) AS pages,
  round(coalesce(avg(processing_time) FILTER (processing_time > 0), 0), 6) AS avg_seconds,
  round(coalesce(quantile_cont(processing_time, 0.5) FILTER (processing_time > 0), 0), 6) AS p50_seconds,
  round(coalesce(quantile_cont(processing_time, 0.95) FILTER (processing_time > 0), 0), 6) AS p95_seconds,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'completed') / count(*) ELSE 0 END, 6) AS success_rate"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job: the one that arrived last."""
    rows = table(spark, sf_dir, "jobs", "job_id", "status", "priority", "total_pages", "pages_completed", "created_at", "started_at", "completed_at", "processing_time", "tenant_id", "loaded_at", "source_file", "error_message", "current_stage")
    order = [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("created_at"), F.asc("status")]
    return a.latest(rows.withColumn("job_key", F.lower(F.trim("job_id"))), ["job_key"], order)


def _measures() -> list:
    return a.measures(F.col("status") == "completed", F.col("status") == "failed", F.col("total_pages"), F.col("processing_time"))


@q("a01_period_stats", f"{_JOBS} SELECT {_MEASURES} FROM job WHERE created_at >= TIMESTAMPTZ '{START}+00' AND created_at < TIMESTAMPTZ '{END}+00'")
def a01_period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter(a.within(F.col("created_at"), START, END)).agg(*_measures())


@q(
    "a01_breakdown",
    _JOBS + "".join(f"{' UNION ALL ' if i else ' '}SELECT '{d}' AS dimension, {d} AS value, {_MEASURES} FROM job WHERE {d} <> '' GROUP BY {d}" for i, d in enumerate(("tenant_id", "status", "priority"))),
)
def a01_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.breakdown(jobs(spark, sf_dir), ["tenant_id", "status", "priority"], _measures())


@q(
    "a02_series",
    f"""{_JOBS}, b AS (SELECT unnest(range(epoch(TIMESTAMPTZ '{START}+00')::BIGINT, epoch(TIMESTAMPTZ '{END}+00')::BIGINT, 864000)) AS s)
SELECT to_timestamp(s) AT TIME ZONE 'UTC' AS bucket_start, to_timestamp(least(s + 864000, epoch(TIMESTAMPTZ '{END}+00')::BIGINT)) AT TIME ZONE 'UTC' AS bucket_end,
  count(job_id) AS jobs, coalesce(sum(total_pages), 0) AS pages
FROM b LEFT JOIN job ON created_at >= to_timestamp(s) AND created_at < to_timestamp(least(s + 864000, epoch(TIMESTAMPTZ '{END}+00')::BIGINT)) GROUP BY s""",
)
def a02_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("total_pages"), F.lit(0)).cast("long").alias("pages")]
    return a.series(jobs(spark, sf_dir), "created_at", START, END, 864000, aggregates)


@q(
    "a03_trend",
    f"""{_JOBS}, t AS (SELECT count(*) FILTER (created_at >= TIMESTAMPTZ '{MIDDLE}+00') AS now_jobs, count(*) FILTER (created_at < TIMESTAMPTZ '{MIDDLE}+00') AS before_jobs,
  coalesce(sum(total_pages) FILTER (created_at >= TIMESTAMPTZ '{MIDDLE}+00'), 0) AS now_pages, coalesce(sum(total_pages) FILTER (created_at < TIMESTAMPTZ '{MIDDLE}+00'), 0) AS before_pages
  FROM job WHERE created_at >= TIMESTAMPTZ '{START}+00' AND created_at < TIMESTAMPTZ '{END}+00')
SELECT now_jobs, before_jobs, now_pages, before_pages,
  round(CASE WHEN before_jobs > 0 THEN (now_jobs - before_jobs) / before_jobs * 100 ELSE 0 END, 4) AS jobs_change,
  round(CASE WHEN before_pages > 0 THEN (now_pages - before_pages) / before_pages * 100 ELSE 0 END, 4) AS pages_change FROM t""",
)
def a03_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("created_at") >= F.lit(MIDDLE).cast("timestamp")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_pages"))), F.lit(0)).cast("long")
    t = jobs(spark, sf_dir).filter(a.within(F.col("created_at"), START, END)).agg(F.count_if(now).alias("now_jobs"), F.count_if(~now).alias("before_jobs"), total(now).alias("now_pages"), total(~now).alias("before_pages"))
    return t.withColumns({"jobs_change": a.change(F.col("now_jobs"), F.col("before_jobs")), "pages_change": a.change(F.col("now_pages"), F.col("before_pages"))})


@q("a04_top_tenants", f"{_JOBS} SELECT tenant_id, count(*) AS jobs FROM job WHERE tenant_id <> '' GROUP BY 1 ORDER BY jobs DESC, min(created_at), tenant_id LIMIT 5")
def a04_top_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = jobs(spark, sf_dir).filter("tenant_id <> ''").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("jobs"), F.min("created_at").alias("first"))
    return counts.orderBy(F.desc("jobs"), F.asc_nulls_last("first"), "tenant_id").limit(5).select("tenant_id", "jobs")


@q(
    "a05_workers",
    """SELECT user_id, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 4) AS avg_seconds,
  round(sum(value), 3) AS seconds, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS pages FROM events WHERE user_id IS NOT NULL GROUP BY 1""",
)
def a05_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "event_type", "value", "props").filter("user_id is not null")
    pages = F.get_json_object("props", "$.k").cast("long")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("value"), 4).alias("avg_seconds"), F.round(F.sum("value"), 3).alias("seconds"), F.sum(pages).alias("pages")
    )


@q(
    "a06_percentiles",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear, max(value) FILTER (r = greatest(ceil(n * 0.95)::BIGINT, 1)) AS nearest_rank, max(value) FILTER (r = least(floor(n * 0.95)::BIGINT, n - 1) + 1) AS floor_index FROM o GROUP BY 1""",
)
def a06_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three definitions side by side."""
    v = F.col("value")
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.round(percentile_linear(v, 0.95), 6).alias("linear"), percentile_nearest_rank(v, 0.95).alias("nearest_rank"), percentile_floor_index(v, 0.95).alias("floor_index"))


@q("a07_recent_percentile", "SELECT round(quantile_cont(value, 0.95), 1) AS p95, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id LIMIT 10000)")
def a07_recent_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the latest 10 000 rows, which is the feature."""
    recent = table(spark, sf_dir, "events", "event_id", "ts", "value").orderBy(F.desc("ts"), "event_id").limit(10000)
    return recent.agg(F.round(percentile_linear(F.col("value"), 0.95), 1).alias("p95"), F.count(F.lit(1)).alias("n"))


@q(
    "a10_tenant_levels",
    f"""{_JOBS}, t AS (SELECT tenant_id, status, processing_time AS s FROM job WHERE tenant_id IS NOT NULL),
ranked AS (SELECT tenant_id, s, row_number() OVER (PARTITION BY tenant_id ORDER BY s) AS r, count(*) OVER (PARTITION BY tenant_id) AS n FROM t WHERE s > 0),
p AS (SELECT tenant_id, max(s) FILTER (r = greatest(ceil(n * 0.95)::BIGINT, 1)) AS p95 FROM ranked GROUP BY 1),
c AS (SELECT tenant_id, count(*) AS jobs, count(*) FILTER (status IN ('completed', 'failed')) AS ended, count(*) FILTER (status = 'completed') AS ok FROM t GROUP BY 1)
SELECT c.tenant_id, jobs, ended, round(CASE WHEN ended > 0 THEN ok / ended ELSE 1.0 END, 4) AS success_rate, p95, coalesce(p95 <= 300, true) AND (CASE WHEN ended > 0 THEN ok / ended ELSE 1.0 END) >= 0.9 AS met FROM c LEFT JOIN p USING (tenant_id)""",
)
def a10_tenant_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate over ended jobs (1 if none), nearest-rank p95 of positive durations, and whether both are met."""
    s = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    c = jobs(spark, sf_dir).filter("tenant_id is not null").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin("completed", "failed")).alias("ended"), F.count_if(F.col("status") == "completed").alias("ok"), percentile_nearest_rank(s, 0.95).alias("p95")
    )
    rate = ratio(F.col("ok"), F.col("ended"), 1.0)
    return c.select("tenant_id", "jobs", "ended", F.round(rate, 4).alias("success_rate"), "p95", (F.coalesce(F.col("p95") <= 300, F.lit(True)) & (rate >= 0.9)).alias("met"))


@q(
    "a14_monthly_usage",
    "SELECT tenant_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS jobs, coalesce(sum(pages_completed), 0) AS pages FROM jobs WHERE tenant_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2",
)
def a14_monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs", "tenant_id", "created_at", "pages_completed").filter("tenant_id is not null and created_at is not null")
    return rows.groupBy("tenant_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("pages_completed"), F.lit(0)).cast("long").alias("pages"))


@q(
    "a17_counts",
    f"{_JOBS} SELECT status, tenant_id, count(*) AS jobs, round(avg(processing_time), 6) AS avg_seconds, grouping(status, tenant_id) AS level FROM job GROUP BY GROUPING SETS ((), (status), (tenant_id), (status, tenant_id))",
)
def a17_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, by tenant, by both and in all, in one pass."""
    status, tenant = F.col("status"), F.col("tenant_id")
    return jobs(spark, sf_dir).groupingSets([[], [status], [tenant], [status, tenant]], status, tenant).agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg("processing_time"), 6).alias("avg_seconds"), F.grouping_id().alias("level"))


@q(
    "a18_recent_rates",
    f"""{_JOBS}, n AS (SELECT max(created_at) AS now FROM job),
r AS (SELECT job.*, n.now FROM job, n WHERE created_at >= n.now - INTERVAL 30 DAY)
SELECT round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'failed') / count(*) ELSE 0.0 END, 4) AS error_rate,
  round(CASE WHEN count(*) FILTER (status IN ('completed', 'failed')) > 0 THEN count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')) ELSE 1.0 END, 4) AS completion_rate,
  count(*) FILTER (status = 'processing' AND started_at < now - INTERVAL 1 HOUR) AS stuck FROM r""",
)
def a18_recent_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    now = rows.agg(F.max("created_at").alias("now"))
    recent = rows.crossJoin(F.broadcast(now)).filter("created_at >= now - interval 30 days")  # one row
    ended = F.count_if(F.col("status").isin("completed", "failed"))
    return recent.agg(
        F.round(ratio(F.count_if(F.col("status") == "failed"), F.count(F.lit(1))), 4).alias("error_rate"), F.round(ratio(F.count_if(F.col("status") == "completed"), ended, 1.0), 4).alias("completion_rate"),
        F.count_if((F.col("status") == "processing") & (F.col("started_at") < F.col("now") - F.expr("interval 1 hour"))).alias("stuck"),
    )


BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)


@q(
    "a19_histogram",
    f"""{_JOBS} SELECT status, b AS bound, count(*) FILTER (b IS NULL OR processing_time <= b) AS at_most FROM job, (SELECT unnest([{', '.join(map(str, BOUNDS))}]::DOUBLE[]) AS b UNION ALL SELECT NULL) bounds
WHERE processing_time IS NOT NULL GROUP BY 1, 2""",
)
def a19_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.cumulative_histogram(jobs(spark, sf_dir), "processing_time", BOUNDS, ["status"])


@q(
    "a20_reviews",
    """WITH r AS (SELECT DISTINCT review_id, status, CAST(created_at AS TIMESTAMPTZ) AS c, TRY_CAST(nullif(reviewed_at, '') AS TIMESTAMPTZ) AS v FROM review_items)
SELECT status, count(*) AS items, min(c) AT TIME ZONE 'UTC' AS oldest, round(avg(epoch_us(v) - epoch_us(c)) / 1e6, 1) AS avg_seconds FROM r GROUP BY 1""",
)
def a20_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "review_items", "review_id", "status", "created_at", "reviewed_at")
    r = rows.select("review_id", "status", F.try_to_timestamp("created_at").alias("c"), F.try_to_timestamp(F.nullif("reviewed_at", F.lit(""))).alias("v")).distinct()
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.min("c").alias("oldest"), F.round(F.avg(F.unix_micros("v") - F.unix_micros("c")) / 1e6, 1).alias("avg_seconds"))


@q(
    "a21_index_stats",
    "SELECT (SELECT count(*) FROM indexed_entities) AS entities, (SELECT count(DISTINCT entity_type) FROM indexed_entities) AS types, (SELECT count(*) FROM review_items) AS reviews, (SELECT count(DISTINCT reason) FROM review_items) AS reasons, (SELECT count(*) FROM (SELECT job_id FROM indexed_entities WHERE job_id IS NOT NULL UNION SELECT job_id FROM review_items WHERE job_id IS NOT NULL)) AS jobs",
)
def a21_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both indexes and the jobs in their union."""
    e, r = table(spark, sf_dir, "indexed_entities", "entity_type", "job_id"), table(spark, sf_dir, "review_items", "reason", "job_id")
    both = e.select("job_id").unionByName(r.select("job_id")).filter("job_id is not null").distinct().agg(F.count(F.lit(1)).alias("jobs"))
    one = lambda df, c, n, k: df.agg(F.count(F.lit(1)).alias(n), F.countDistinct(c).alias(k))
    return one(e, "entity_type", "entities", "types").crossJoin(one(r, "reason", "reviews", "reasons")).crossJoin(both)  # three single rows


@q(
    "a22_batch_status",
    f"""{_JOBS} SELECT split_part(source_file, '/', 2)[1:1] AS batch, count(*) AS jobs,
  CASE WHEN count(*) FILTER (status = 'processing') > 0 THEN 'processing' WHEN count(*) FILTER (status NOT IN ('completed', 'failed', 'cancelled')) = count(*) THEN 'pending'
       WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (status = 'completed') = count(*) THEN 'completed' ELSE 'partial' END AS batch_status FROM job WHERE source_file IS NOT NULL GROUP BY 1""",
)
def a22_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a group of jobs from those of its members (the group is the file name's first letter)."""
    n, is_ = F.count(F.lit(1)), lambda s: F.count_if(F.col("status") == s)
    open_ = F.count_if(~F.col("status").isin("completed", "failed", "cancelled"))
    state = F.when(is_("processing") > 0, "processing").when(open_ == n, "pending").when(is_("failed") == n, "failed").when(is_("completed") == n, "completed").otherwise("partial")
    batch = F.substring(F.split_part("source_file", F.lit("/"), F.lit(2)), 1, 1)
    return jobs(spark, sf_dir).filter("source_file is not null").groupBy(batch.alias("batch")).agg(n.alias("jobs"), state.alias("batch_status"))


@q(
    "a37_value_stats",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END, 6) AS sd, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median,
  round(CASE WHEN count(value) > 1 AND avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS variation FROM events GROUP BY 1""",
)
def a37_value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0), 6).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.round(percentile_linear(v, 0.5), 6).alias("median"), F.round(coefficient_of_variation(v), 6).alias("variation"),
    )


@q("a38_hours", "SELECT h AS hour, count(event_id) AS events, round(coalesce(sum(value), 0), 3) AS total FROM range(24) t(h) LEFT JOIN events ON hour(ts) = h GROUP BY 1")
def a38_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.hours(table(spark, sf_dir, "events", "ts", "value"), "ts", [F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 3).alias("total")])


@q(
    "w16_anomalies",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT count(*) AS k, avg(n) AS m, stddev_samp(n) AS sd FROM d)
SELECT day, n, round((n - m) / sd, 6) AS z FROM d, s WHERE k >= 3 AND sd > 0 AND abs((n - m) / sd) > 2""",
)
def w16_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return a.outliers(days, "n").withColumn("z", F.round("z", 6))


@q(
    "w17_previous_period",
    """WITH m AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, lag(n) OVER (ORDER BY day) AS before, round(CASE WHEN lag(n) OVER (ORDER BY day) > 0 THEN (n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day) * 100 ELSE 0 END, 4) AS change FROM m""",
)
def w17_previous_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day against the one before; the window runs over days, not rows."""
    days = table(spark, sf_dir, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.withColumn("before", F.lag("n").over(Window.orderBy("day")))
    return before.withColumn("change", a.change(F.col("n"), F.coalesce("before", F.lit(0))))


@q(
    "t03_buckets",
    "SELECT to_timestamp(floor(epoch(ts) / 3600)::BIGINT * 3600) AT TIME ZONE 'UTC' AS bucket, count(*) AS events, round(sum(value), 3) AS total, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1",
)
def t03_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from the epoch on; hours without rows are left out."""
    rows = table(spark, sf_dir, "events", "ts", "value")
    v = F.col("value")
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(v), 3).alias("total"), F.round(percentile_linear(v, 0.5), 4).alias("p50"), F.round(percentile_linear(v, 0.99), 4).alias("p99")).select(F.col("w.start").alias("bucket"), "events", "total", "p50", "p99")


@q(
    "t02_dashboard",
    """WITH n AS (SELECT max(ts) AS now FROM events), w AS (SELECT unnest([60, 300, 900, 3600, 86400]) AS seconds)
SELECT seconds, count(event_id) AS events, round(count(event_id) / (seconds / 60), 6) AS per_minute, round(coalesce(avg(value), 0), 4) AS avg_value, round(coalesce(quantile_cont(value, 0.95), 0), 4) AS p95
FROM w CROSS JOIN n LEFT JOIN events ON ts > now - to_seconds(seconds) AND ts <= now GROUP BY 1""",
)
def t02_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the last minute to day before the newest row, over the nominal window, in one pass."""
    rows = table(spark, sf_dir, "events", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))  # one row
    age = F.unix_micros("now") - F.unix_micros("ts")
    windows = (60, 300, 900, 3600, 86400)
    near = rows.crossJoin(now).withColumn("age", age).filter(F.col("age") < 86400 * 1_000_000)
    each = near.withColumn("seconds", F.explode(F.filter(F.array(*map(F.lit, windows)), lambda s: F.col("age") < s * F.lit(1_000_000).cast("long"))))
    v = F.col("value")
    found = each.groupBy("seconds").agg(F.count(F.lit(1)).alias("events"), F.avg(v).alias("m"), percentile_linear(v, 0.95).alias("p"))
    every = spark.createDataFrame([(s,) for s in windows], "seconds int")
    n = F.coalesce("events", F.lit(0))
    return every.join(found, "seconds", "left").select("seconds", n.alias("events"), F.round(n / (F.col("seconds") / 60), 6).alias("per_minute"), F.round(F.coalesce("m", F.lit(0.0)), 4).alias("avg_value"), F.round(F.coalesce("p", F.lit(0.0)), 4).alias("p95"))
