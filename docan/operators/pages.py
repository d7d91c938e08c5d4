"""Page sequences: missing pages, context, running numbers and their continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_chunks(totals: DataFrame, existing: DataFrame, key: str, total: str, page: str, size: int) -> DataFrame:
    """(key, first, last): missing pages as contiguous runs of at most ``size``.

    Instead of listing all pages, each existing page is compared with the one before it, so that a
    document costs its existing pages and its gaps.
    """
    pages = existing.join(totals.select(key, F.col(total).alias("__n")), key).filter((F.col(page) >= 1) & (F.col(page) <= F.col("__n"))).select(key, F.col(page).cast("long").alias("p"), F.col("__n").cast("long").alias("n")).distinct()
    ends = totals.filter(F.col(total) > 0).select(key, (F.col(total) + 1).cast("long").alias("p"), F.col(total).cast("long").alias("n"))
    w = Window.partitionBy(key).orderBy("p")
    gaps = pages.unionByName(ends).withColumn("first", F.coalesce(F.lag("p").over(w), F.lit(0)) + 1).withColumn("last", F.col("p") - 1).filter("last >= first")
    parts = gaps.withColumn("first", F.explode(F.sequence("first", "last", F.lit(size).cast("long"))))
    return parts.select(key, "first", F.least(F.col("first") + size - 1, "last").alias("last"))


def context(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Adds the first line of the pages before and after, and the numbers of pages before and after those."""
    w = Window.partitionBy(key).orderBy(page)
    head = F.substring(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1)), 1, 200)
    rows = pages.withColumn("__head", head)
    earlier = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -2))
    later = F.count(F.lit(1)).over(w.rowsBetween(2, Window.unboundedFollowing))
    return rows.withColumns({"before": F.lag("__head").over(w), "after": F.lead("__head").over(w), "earlier": earlier, "later": later}).drop("__head")


def running_numbers(rows: DataFrame, group: Sequence[str], order: Sequence[Column], prefix: str, start: int, width: int) -> DataFrame:
    """Adds ``number``: prefix and zero-padded counter from ``start`` in each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (start - 1)
    return rows.withColumn("number", F.concat(F.lit(prefix), F.format_string(f"%0{width}d", n)))


def continuity(rows: DataFrame, number: str, pattern: str = r"^([A-Za-z]+)\s?(\d+)$") -> DataFrame:
    """Per prefix of numbered items: how many, first and last number, duplicates and gaps."""
    parsed = rows.select(F.regexp_extract(number, pattern, 1).alias("prefix"), F.regexp_extract(number, pattern, 2).alias("digits")).filter("digits <> ''").select("prefix", F.col("digits").cast("long").alias("n"))
    counts = parsed.groupBy("prefix", "n").agg(F.count(F.lit(1)).alias("times"))
    return counts.groupBy("prefix").agg(
        F.sum("times").alias("items"), F.min("n").alias("first"), F.max("n").alias("last"), F.count_if(F.col("times") > 1).alias("duplicates"), (F.max("n") - F.min("n") + 1 - F.count(F.lit(1))).alias("missing")
    )
