"""Folders of files, logs of JSON lines, failure lists and sidecar files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of files (hexadecimal), and the family they stand for.
MAGIC = {
    "pdf": ["25504446"],
    "image": ["FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A", "424D", "474946383761", "474946383961"],
    "video": ["1A45DFA3", "000001BA", "000001B3"],
}
SUPPORTED = ("pdf", "tif", "tiff", "png", "jpg", "jpeg", "bmp", "gif", "mp4", "mov", "avi", "mkv")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def magic_family(content: Column) -> Column:
    """Family of a file by its first bytes; null where unknown. RIFF and ISO media are told by later bytes."""
    head = F.hex(F.substring(content, 1, 16))
    family = None
    for name, heads in MAGIC.items():
        test = head.startswith(heads[0])
        for h in heads[1:]:
            test = test | head.startswith(h)
        family = F.when(test, name) if family is None else family.when(test, name)
    riff = head.startswith("52494646")
    return family.when(riff & (F.substring(head, 17, 8) == "41564920"), "video").when(riff & (F.substring(head, 17, 8) == "57454250"), "image").when(F.substring(head, 9, 8) == "66747970", "video")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def scan_folder(spark: SparkSession, folder: str, extensions: Sequence[str] = SUPPORTED) -> DataFrame:
    """(path, modified, size, extension, family, fingerprint) of the files of a folder tree.

    The content is read only for its first bytes, which the binary source streams per file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = files.withColumn("extension", extension(F.col("path"))).filter(F.col("extension").isin(*extensions))
    mark = F.sha2(F.concat_ws(":", "path", F.unix_seconds("modificationTime"), "length"), 256)
    return kept.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "extension", magic_family(F.col("content")).alias("family"), mark.alias("fingerprint"))


def digest_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file of a folder tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The lines of a log, parsed, with the line itself in ``raw``; blank lines are left out, broken ones keep nulls."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw")).select("r.*", "raw")


def filter_log(rows: DataFrame, since: str | None = None, least_level: str = "DEBUG", time: str = "timestamp", level: str = "level") -> DataFrame:
    """Log rows after ``since`` of at least a level. A time that cannot be read is kept; an unknown level counts as INFO."""
    rank = F.coalesce(*(F.when(F.upper(level) == n, F.lit(i)) for i, n in enumerate(LEVELS)), F.lit(1))
    rows = rows.filter(rank >= LEVELS.index(least_level))
    if since is not None:
        at = F.try_to_timestamp(time)
        rows = rows.filter(at.isNull() | (at > F.lit(since).cast("timestamp")))
    return rows


# The columns of both generations of failure lists.
OLD_FAILURES = ("Timestamp", "SourcePath", "PageNum", "Error")
NEW_FAILURES = (*OLD_FAILURES, "FailureType", "Status", "RetryCount", "DpiUsed", "LastRetryTimestamp", "ResolutionMethod")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure lists with the old or the new header; what the old one lacks has its default."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in NEW_FAILURES])
    rows = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True, quote='"', escape='"', multiLine=True)
    default = {"FailureType": "unknown", "Status": "failed", "RetryCount": "0", "DpiUsed": "300", "LastRetryTimestamp": "", "ResolutionMethod": ""}
    named = [F.coalesce(F.col(c), F.lit(default.get(c))).alias(c) for c in NEW_FAILURES]
    number = lambda c, d: F.coalesce(F.col(c).try_cast("int"), F.lit(d)).alias(c)
    rows = rows.select(*named)
    return rows.select(*(number(c, {"PageNum": 0, "RetryCount": 0, "DpiUsed": 300}[c]) if c in ("PageNum", "RetryCount", "DpiUsed") else F.col(c) for c in NEW_FAILURES))


def retriable(rows: DataFrame, most: int = 3) -> DataFrame:
    """Failures worth another try: open, tried less than ``most`` times, of a family that can succeed."""
    return rows.filter(~F.col("Status").isin("resolved", "retry_exhausted", "not_retriable") & (F.col("RetryCount") < most) & ~F.col("FailureType").isin("extract_failed", "critical"))


def pair_by_stem(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Inner join of two sets of files on their names without folder and extension."""
    stem = lambda df: df.withColumn("stem", F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))
    return stem(left).join(stem(right).withColumnsRenamed({c: f"other_{c}" for c in right.columns}), "stem")


def sanitise_segment(name: Column) -> Column:
    """A name that can stand in a path."""
    clean = F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.regexp_replace(clean, r"[._]", "") == "", F.lit("unnamed")).otherwise(clean)


def write_sidecars(rows: DataFrame, folder: str, document: str, kind: str) -> None:
    """One JSON line per row under ``folder/kind=.../``; an existing kind is replaced."""
    body = F.to_json(F.struct(*(F.col(c) for c in rows.columns)), {"ignoreNullFields": "false"})
    rows.select(F.lit(kind).alias("kind"), F.col(document).cast("string").alias("document"), body.alias("body")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(folder)


def read_sidecars(spark: SparkSession, folder: str, kind: str, schema: T.StructType | str) -> DataFrame:
    """Rows of one kind; only its partition is read."""
    return spark.read.parquet(folder).filter(F.col("kind") == kind).select(F.from_json("body", schema).alias("r")).select("r.*")


def manifest(files: DataFrame) -> DataFrame:
    """Files and bytes per extension."""
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def markdown(rows: DataFrame, document: str, title: str, fields: Sequence[str]) -> DataFrame:
    """(document, markdown): a heading and a table of fields for each row."""
    from docan.functions.texts import escape_cell

    lines = [F.concat(F.lit("# "), escape_cell(F.col(title).cast("string"))), F.lit(""), F.lit("| field | value |"), F.lit("| --- | --- |")]
    lines += [F.concat(F.lit(f"| {f} | "), escape_cell(F.col(f).cast("string")), F.lit(" |")) for f in fields]
    return rows.select(document, F.concat_ws("\n", *lines).alias("markdown"))


def missing_columns(rows: DataFrame, schema: T.StructType) -> list[str]:
    """Fields of a declared schema that a frame lacks or holds in another type."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    return [f.name for f in schema.fields if have.get(f.name) != f.dataType]


# Kinds of events and the topics they are published to.
TOPICS = {"job": "jobs.lifecycle", "page": "pages.processed", "document": "documents.completed", "review": "reviews.updated"}


def topic(event_type: Column) -> Column:
    """Topic of an event by the part of its type before the dot; others go to one of their own."""
    head = F.split_part(event_type, F.lit("."), F.lit(1))
    return F.coalesce(*(F.when(head == k, F.lit(v)) for k, v in TOPICS.items()), F.lit("events.other"))


def kafka_rows(events: DataFrame, key: str) -> DataFrame:
    """(topic, key, value) as the Kafka sink takes them, keyed so that one job's events stay in order."""
    return events.select(topic(F.col("event_type")).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
