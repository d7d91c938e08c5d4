"""Queries that run as streams over what there is, and queries over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.plans.registry import Registry
from docan.session import shared_folder
from docan.sources.files import kafka_rows
from docan.sources.tables import table
from docan.streaming import metrics as m

registry = Registry()
q = registry.query


@q(
    "t01_stream_windows",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 3) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def t01_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed windows of six hours, by a stream over the table's files."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a pattern, as the table may be one file or a folder of them; all in one batch, as its files are in no order of time
    stream = m.follow(spark, f"{sf_dir}/events.parque[t]", rows.schema, 1_000_000).withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done = m.run_to_end(m.windowed(stream, "ts", "value", "6 hours", keys=("event_type",)), f"{base}/out", f"{base}/state")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 3).alias("total"))


@q("s13_topics", "SELECT CASE split_part(event_type, '.', 1) WHEN 'job' THEN 'jobs.lifecycle' WHEN 'page' THEN 'pages.processed' WHEN 'document' THEN 'documents.completed' WHEN 'review' THEN 'reviews.updated' ELSE 'events.other' END AS topic, count(*) AS events FROM (SELECT DISTINCT event_id, event_type FROM job_events) GROUP BY 1")
def s13_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_events", "event_id", "event_type").distinct()
    return kafka_rows(rows, "event_id").groupBy("topic").agg(F.count(F.lit(1)).alias("events"))


@q(
    "t05_stale_workers",
    "SELECT user_id::VARCHAR AS worker, max(ts) AS last, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS offline FROM events WHERE user_id IS NOT NULL GROUP BY 1",
)
def t05_stale_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "ts").filter("user_id is not null").select(F.col("user_id").cast("string").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    now = str(rows.agg(F.max("ts")).first()[0])
    return m.stale_workers(rows, now, 6 * 3600).withColumn("last", F.col("last").cast("timestamp_ntz"))
