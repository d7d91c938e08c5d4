"""Problem 9: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.contamination import leaks, matches, remove_leaks
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()

_FOUND_SQL = """
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS passage FROM i WHERE len(w) >= 12),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS passage FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM g JOIN p USING (passage)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


@registry.query("p9_found", _FOUND_SQL)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_matches(spark, sf_dir)).select("doc_id", "item_id")


@registry.query("p9_items")
def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that hold a part of it and the longest verbatim match in words."""
    return leaks(_matches(spark, sf_dir)).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("n_words").alias("longest"))


@registry.query("p9_clean")
def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and how many remain once those with a leak are removed."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    kept = remove_leaks(docs, _matches(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return every.join(kept, every["source"].eqNullSafe(kept["source"]), "left").select(every["source"], "documents", F.coalesce("kept", F.lit(0)).alias("kept"))
