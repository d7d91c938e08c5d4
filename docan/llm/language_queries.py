"""Problem 1: missing or wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.languages import fit, verdicts
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "lang_samples"))
    spans = table(spark, sf_dir, "translation_spans", "document_id", "span_id", "source_language", "source_text")
    return verdicts(spans, ["document_id", "span_id"], "source_language", "source_text", model)


@registry.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _verdicts(spark, sf_dir).filter(F.col("kind").isin("missing", "wrong", "mixed"))
    return cases.select("document_id", "span_id", F.explode("languages").alias("language")).distinct()


@registry.query("p1_segments")
def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every span and of every segment of a mixed one; spans without a sentence have a guess."""
    part = _verdicts(spark, sf_dir).select("document_id", "span_id", "declared", "kind", "guess", F.posexplode_outer("segments").alias("segment", "s"))
    known = lambda c: F.coalesce(f"s.{c}", f"guess.{c}").alias(c)
    return part.select("document_id", "span_id", "declared", "kind", "segment", "s.begin", "s.end", known("language"), known("confidence")).distinct()
