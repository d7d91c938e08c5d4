"""Hash-chained event logs: building, verifying, signing.

The hash of an event is SHA-256 over its JSON with sorted keys, default separators and ASCII escapes,
the hash of the event before it included. Building is a fold over a document's events in order; the
events are sorted within partitions and streamed through, so no document is held in memory as a whole.
Verifying needs of each event only the stored hash before it and is parallel over events.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CHAIN = "document_id string, seq long, event_type string, timestamp string, data string, prev_hash string, hash string"


def event_hash(document: str, kind: str, timestamp: str, data: str | None, before: str | None) -> str:
    """``data`` is JSON text; what cannot be read is hashed as a string."""
    try:
        payload = json.loads(data) if data else {}
    except ValueError:
        payload = data
    event = {"document_id": document, "event_type": kind, "timestamp": timestamp, "data": payload, "prev_hash": before}
    return hashlib.sha256(json.dumps(event, sort_keys=True, default=str).encode("utf-8")).hexdigest()


def build(events: DataFrame) -> DataFrame:
    """Chains of (document_id, order_key, event_type, timestamp, data), each document's in the order of ``order_key``."""
    ordered = events.select("document_id", "event_type", "timestamp", "data", "order_key").repartition("document_id").sortWithinPartitions("document_id", "order_key").drop("order_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, seq = object(), None, 0
        for batch in batches:
            out: list[list] = [[], [], []]
            for document, kind, timestamp, data in zip(*(c.to_pylist() for c in batch.columns)):
                if document != current:
                    current, before, seq = document, None, 0
                own = event_hash(document, kind, timestamp, data, before)
                for column, v in zip(out, (seq, before, own)):
                    column.append(v)
                before, seq = own, seq + 1
            arrays = [batch.column(0), pa.array(out[0], type=pa.int64()), *batch.columns[1:4], pa.array(out[1], type=pa.string()), pa.array(out[2], type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["document_id", "seq", "event_type", "timestamp", "data", "prev_hash", "hash"])

    return ordered.mapInArrow(run, CHAIN)


def verify(chain: DataFrame, empty_as_null: bool = False) -> DataFrame:
    """(document_id, events, valid, first_break, reason) of stored chains.

    An event breaks the chain where it does not name the hash before it (``link``) or its own hash is
    not that of its contents (``hash``). ``empty_as_null``: a first event may name the empty string.
    """

    @pandas_udf(T.StringType())
    def rehash(document: pd.Series, kind: pd.Series, timestamp: pd.Series, data: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([event_hash(*row) for row in zip(document, kind, timestamp, data, before)])

    before = F.lag("hash").over(Window.partitionBy("document_id").orderBy("seq"))
    stored = F.when(F.col("prev_hash") != "", F.col("prev_hash")) if empty_as_null else F.col("prev_hash")
    rows = chain.withColumn("expected", before).withColumn("own", rehash("document_id", "event_type", "timestamp", "data", "prev_hash"))
    reason = F.when(~stored.eqNullSafe(F.col("expected")), "link").when(F.col("own") != F.col("hash"), "hash")
    rows = rows.withColumn("reason", reason)
    broken = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("events"), broken.alias("b")).select("document_id", "events", F.col("b").isNull().alias("valid"), F.col("b.seq").alias("first_break"), F.col("b.reason").alias("reason"))


def sign(column: str, key: bytes):
    """Column with the HMAC-SHA-256 of a text column."""

    @pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode("utf-8"), hashlib.sha256).hexdigest())

    return run(column)
