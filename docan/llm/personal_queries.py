"""Problem 5: personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.key_filter import distinct_by
from docan.llm.personal import masked
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()


def _records(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    entities = table(spark, sf_dir, "indexed_entities", "entity_id", "entity_type", "text")
    other = entities.filter(F.coalesce("entity_type", F.lit("")).isin("PERSON", "ORG") == F.lit(False))
    return [
        ("retrieval_documents", table(spark, sf_dir, "retrieval_documents", "document_id", "text").toDF("record_key", "text")),
        ("indexed_entities", other.select(F.col("entity_id").alias("record_key"), "text")),
    ]


def _masked(spark: SparkSession, sf_dir: str, with_text: bool, **more: bool) -> DataFrame:
    parts = []
    for name, rows in _records(spark, sf_dir):
        done = masked(rows, ["record_key"], "text", with_text=with_text, **more)
        parts.append(done.select(F.lit(name).alias("record_table"), *done.columns))
    return parts[0].unionByName(parts[1])


@registry.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, False).select("record_table", "record_key", F.explode("types").alias("pii_type")).distinct()


@registry.query("p5_texts")
def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of personal data."""
    return distinct_by(_masked(spark, sf_dir, True), "record_table", "record_key")


@registry.query("p5_pseudonyms")
def p5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with account numbers and dates permuted as well, for use where no date may stay."""
    return distinct_by(_masked(spark, sf_dir, True, dates=True, with_accounts=True), "record_table", "record_key")
