"""Streams of metrics, alerts and completions, and their batch twins.

The watermark is an hour unless given: rows later than that are left out of windows that have closed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WATERMARK = "1 hour"


def follow(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 64, file_format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers what was taken."""
    return spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def windowed(rows: DataFrame, ts: str, value: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), watermark: str = WATERMARK) -> DataFrame:
    """(start, keys, events, total, mean) per window; works on streams and on tables."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, watermark)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *keys, "events", "total", "mean")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now into a Parquet folder, and reads that."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)


ALERTS = "queue string, ts timestamp, severity string, state string, depth long"
_OPEN = "warning boolean, critical boolean"


def alerts(depths: DataFrame, warning: int, critical: int) -> DataFrame:
    """Alerts of (queue, ts, depth): FIRING when a limit is reached, RESOLVED for all open ones below the warning limit.

    A limit that is already firing is not reported again; critical goes before warning.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("warning", "critical"), state.get)) if state.exists else {"warning": False, "critical": False}
        out = []
        for frame in frames:
            for ts, depth in frame.sort_values("ts")[["ts", "depth"]].itertuples(index=False):
                name = "critical" if depth >= critical else "warning" if depth >= warning else None
                if name is None:
                    out += [(key[0], ts, n, "RESOLVED", depth) for n, on in held.items() if on]
                    held = {"warning": False, "critical": False}
                elif not held[name]:
                    held[name] = True
                    out.append((key[0], ts, name, "FIRING", depth))
        state.update((held["warning"], held["critical"]))
        yield pd.DataFrame(out, columns=["queue", "ts", "severity", "state", "depth"])

    return depths.groupBy("queue").applyInPandasWithState(step, ALERTS, _OPEN, "append", "NoTimeout")


def completed(pages: DataFrame) -> DataFrame:
    """(document_id, pages) of the documents of (document_id, page, total), once, when the last page has come.

    The state of a document is the set of its pages seen, as the first message of a page counts.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, done = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        total = None
        for frame in frames:
            seen |= set(frame["page"].tolist())
            total = int(frame["total"].max()) if len(frame) else total
        emit = not done and total is not None and len(seen) >= total
        state.update((sorted(seen), done or emit))
        yield pd.DataFrame([(key[0], len(seen))] if emit else [], columns=["document_id", "pages"])

    return pages.groupBy("document_id").applyInPandasWithState(step, "document_id string, pages long", "seen array<long>, done boolean", "append", "NoTimeout")


def stale_workers(beats: DataFrame, now: str, timeout_seconds: int = 60) -> DataFrame:
    """(worker, last, offline) at a given moment, from (worker, ts)."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last"))
    return last.withColumn("offline", F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last") > timeout_seconds * 1_000_000)


def once(events: DataFrame, key: str, ts: str, watermark: str = WATERMARK) -> DataFrame:
    """Events without repetitions: of a stream within the watermark, of a table at all."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def retained(events: DataFrame, ts: str, now: str, hours: int = 72) -> DataFrame:
    """Events not older than the time they are kept."""
    return events.filter(F.col(ts) > F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
