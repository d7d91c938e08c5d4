"""Pages and entities rolled up to documents, and quality measures of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docan.functions.numbers import ratio


def entity_summary(rows: DataFrame, document: str) -> DataFrame:
    """(document, entity_type, entities, distinct_texts, pages) with the pages as a sorted list."""
    key = F.lower(F.trim("text"))
    return rows.groupBy(document, "entity_type").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(key).alias("distinct_texts"), F.sort_array(F.collect_set("page")).alias("pages"))


def first_seen(rows: DataFrame, document: str, order: Sequence[Column]) -> DataFrame:
    """Distinct (type, text) of a document in the spelling seen first."""
    w = Window.partitionBy(document, "entity_type", F.lower(F.trim("text"))).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def language_shares(spans: DataFrame, keys: Sequence[str], language: str, size: Column, confidence: str) -> DataFrame:
    """(keys, language, chars, share, confidence): shares of characters, confidence weighted by them."""
    chars = spans.withColumn("__n", size)
    by = chars.groupBy(*keys, language).agg(F.sum("__n").alias("chars"), F.sum(F.col("__n") * F.col(confidence)).alias("__c"))
    whole = F.sum("chars").over(Window.partitionBy(*keys))
    return by.withColumn("share", ratio(F.col("chars"), whole)).withColumn("confidence", ratio(F.col("__c"), F.col("chars"))).drop("__c")


def main_language(shares: DataFrame, keys: Sequence[str], language: str) -> DataFrame:
    """The language of most characters; of equals the last by code."""
    return shares.groupBy(*keys).agg(F.max(F.struct("chars", language)).alias("m")).select(*keys, F.col(f"m.{language}").alias(language))


def votes(pages: DataFrame, document: str, label: str, confidence: str) -> DataFrame:
    """Majority label of a document's pages; then the higher mean confidence; then the first by name."""
    by = pages.filter(F.col(label).isNotNull()).groupBy(document, label).agg(F.count(F.lit(1)).alias("pages"), F.avg(confidence).alias("mean"))
    w = Window.partitionBy(document).orderBy(F.desc("pages"), F.desc_nulls_last("mean"), label)
    return by.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, support, precision, recall, f1) of every label that is true or guessed somewhere.

    One pass: every row counts for its true and its guessed label.
    """
    each = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), F.col(truth).alias("t"), F.col(guess).alias("g")).filter("label is not null")
    hit, true, said = F.count_if((F.col("t") == F.col("label")) & (F.col("g") == F.col("label"))), F.count_if(F.col("t") == F.col("label")), F.count_if(F.col("g") == F.col("label"))
    counts = each.groupBy("label").agg(true.alias("support"), ratio(hit, said).alias("p"), ratio(hit, true).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return counts.select("label", "support", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def reliability(rows: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share_true, gap) over equal bins of the score, which is held within 0 and 1.

    ``gap`` is n times the difference of share and mean, from a decimal sum of the scores as they are printed, so
    that it is the same in every order of rows; null where a score is no decimal (NaN, infinite, 1e10 or more).
    """
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    b = F.least(F.floor(held * bins), F.lit(bins - 1)).cast("int")
    exact, truth, n = F.col(score).try_cast("decimal(28,18)"), label.cast("double"), F.count(F.lit(1))
    true = F.when(F.count(truth) == n, F.try_sum(truth.try_cast("decimal(28,18)"))).otherwise((n * F.avg(truth)).try_cast("decimal(38,18)"))
    gap = F.when(F.count(exact) == n, F.abs(F.try_subtract(true, F.try_sum(exact))))
    return rows.filter(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(n.alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("share_true"), gap.alias("gap"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Mean gap between score and truth over the bins, weighted by their rows; a half of the last digit is rounded up."""
    gap = F.col("n") * F.abs(F.col("share_true") - F.col("mean_score"))
    exact = F.when(F.count("gap") == F.count(gap), F.round(F.try_divide(F.try_sum("gap"), F.sum("n").cast("decimal(20,0)")), 6).cast("double"))
    return table.agg(F.coalesce(exact, F.round(F.sum(gap) / F.sum("n"), 6)).alias("ece"))


def quality_class(rate: Column, confidence: Column) -> Column:
    """Class of a document by the share of pages with text and the mean confidence (fixed limits)."""
    return F.when((rate >= 1.0) & (confidence >= 0.85), "high_quality").when((rate >= 0.80) & (confidence >= 0.60), "acceptable").when((rate >= 0.50) | (confidence >= 0.40), "degraded").otherwise("review_required")
