"""Problem 6: noise in text from scanned pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.scans import contexts, likeliest, repaired, running_headers, settled, surveyed, verdicts, with_first, word_counts
from docan.plans.registry import Registry
from docan.session import checkpoint
from docan.sources.tables import table

registry = Registry()

_NAMES = ("retrieval_documents", "bundle_pages")


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(key, doc, page, text, headers) of both tables."""
    docs = table(spark, sf_dir, "retrieval_documents", "document_id", "text")
    pages = table(spark, sf_dir, "bundle_pages", "page_id", "document_id", "page_number", "text")
    whole = docs.select(F.col("document_id").alias("key"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("int").alias("page"), "text", F.lit(None).cast("array<string>").alias("headers"))
    headed = pages.join(running_headers(pages, "document_id", "page_id", "text"), pages["document_id"] == F.col("doc"), "left")
    each = headed.select(F.col("page_id").alias("key"), F.col("document_id").alias("doc"), F.col("page_number").alias("page"), "text", "headers")
    return whole, each


def _surveys(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Rows of both tables, their survey, and the verdicts on all their tokens."""
    rows = _rows(spark, sf_dir)
    texts = rows[0].select("text").unionByName(table(spark, sf_dir, "bundle_pages", "text"))
    counts = checkpoint(word_counts(texts, "text"))
    fine = settled(counts)
    read = [surveyed(rows[0], fine, True), surveyed(rows[1], fine, False)]
    both = checkpoint(reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("record_table"), *r.columns) for n, r in zip(_NAMES, read)]))
    pages = with_first(both.filter(F.col("record_table") == _NAMES[1]))
    both = both.filter(F.col("record_table") == _NAMES[0]).unionByName(pages)
    return list(rows), both, checkpoint(verdicts(both, counts))


@registry.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, read, wrong = _surveys(spark, sf_dir)
    plain = read.select("record_table", F.col("key").alias("record_key"), F.explode("kinds").alias("noise_kind"))
    tokens = read.select("record_table", F.col("key").alias("record_key"), F.explode("tokens").alias("token"))
    misread = tokens.join(wrong, "token", "left_semi").select("record_table", "record_key", F.lit("misread").alias("noise_kind"))
    return plain.unionByName(misread).distinct()


@registry.query("p6_texts")
def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as continuous paragraphs."""
    rows, read, wrong = _surveys(spark, sf_dir)
    held = read.select("record_table", "key", F.explode("tokens").alias("token")).join(wrong, "token").groupBy("record_table", "key").agg(F.collect_set(F.struct("token", "candidates")).alias("wrong"))
    held = checkpoint(held)
    texts = rows[0].select("text").unionByName(table(spark, sf_dir, "bundle_pages", "text"))
    parts = []
    for name, frame, whole in zip(_NAMES, rows, (True, False)):
        own = held.filter(F.col("record_table") == name).select("key", "wrong")
        # equal rows fall together where the texts already lie by key
        parts.append((name, whole, frame.select("key", "text", "headers").join(own, "key", "left").dropDuplicates(["key", "text"])))
    places = checkpoint(reduce(DataFrame.unionByName, [contexts(frame, whole).select(F.lit(name).alias("record_table"), "*") for name, whole, frame in parts]))
    best = likeliest(places, wrong, texts, "text").groupBy("record_table", "key").agg(F.collect_set(F.struct("token", "left", "right", "word")).alias("best"))
    out = [repaired(frame.join(best.filter(F.col("record_table") == name).drop("record_table"), "key", "left"), whole).select(F.lit(name).alias("record_table"), F.col("key").alias("record_key"), "text") for name, whole, frame in parts]
    return out[0].unionByName(out[1])
