"""Problem 3: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docan.llm.names import entities, linked_pairs
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "indexed_entities", "entity_type", "text"), "entity_type", "text")


@registry.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(_entities(spark, sf_dir)).withColumnRenamed("kind", "entity_type")


@registry.query("p3_entities")
def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity of every spelling."""
    return _entities(spark, sf_dir).toDF("entity_type", "name", "entity")
