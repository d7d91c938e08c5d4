"""Problem 10: long exact spans shared between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docan.llm.shared_spans import shares, stretches
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()

_FOUND_SQL = """
WITH w AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 398), lambda k: md5_number(substr(text, k, 400)))) AS h FROM documents WHERE length(text) >= 400),
h AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) SELECT DISTINCT doc_id FROM w JOIN h USING (h)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@registry.query("p10_found", _FOUND_SQL)
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches(_documents(spark, sf_dir)).select("id").distinct().withColumnRenamed("id", "doc_id")


@registry.query("p10_stretches")
def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parts found elsewhere, as code point positions [begin, end)."""
    return stretches(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@registry.query("p10_share")
def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's text that is found elsewhere."""
    docs = _documents(spark, sf_dir)
    return shares(docs, stretches(docs)).withColumnRenamed("id", "doc_id")
