"""Labels of tokens and documents: merging, scoring, taxonomies and calibration of their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docan.functions.numbers import ratio


def bio_spans(tokens: DataFrame, document: str, position: str, tag: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(document, type, begin, end, ...) of tags B-x, I-x and O; an I- without an open span of its type begins one."""
    w = Window.partitionBy(document).orderBy(position)
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substring(tag, 3, 1000))
    rows = tokens.withColumn("type", kind).withColumn("__prev", F.lag("type").over(w))
    starts = F.col("type").isNotNull() & (F.col(tag).startswith("B-") | ~F.col("type").eqNullSafe(F.col("__prev")))
    rows = rows.withColumn("__n", F.sum(starts.cast("int")).over(w)).filter("type is not null")
    return rows.groupBy(document, "__n", "type").agg(F.min(position).alias("begin"), F.max(position).alias("end"), *extra).drop("__n")


def span_scores(truth: DataFrame, guess: DataFrame, document: str) -> DataFrame:
    """(type, support, precision, recall, f1) of spans that agree in document, type, begin and end."""
    key = [document, "type", "begin", "end"]
    both = truth.select(*key).distinct().withColumn("__t", F.lit(1)).join(guess.select(*key).distinct().withColumn("__g", F.lit(1)), key, "full_outer")
    hit, t, g = F.count_if(F.col("__t").isNotNull() & F.col("__g").isNotNull()), F.count("__t"), F.count("__g")
    s = both.groupBy("type").agg(t.alias("support"), ratio(hit, g).alias("p"), ratio(hit, t).alias("r"))
    return s.select("type", "support", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))


def taxonomy(rows: DataFrame, key: str, text: str, words: Mapping[str, Sequence[str]], least: float = 0.3, exclusive: bool = False) -> DataFrame:
    """(key, label, confidence, matched) of the labels at least a share of whose keywords occur (ASCII case-insensitively)."""
    low = F.lower(text)

    def one(label: str, own: Sequence[str]) -> Column:
        found = F.filter(F.array(*(F.lit(w.lower()) for w in own)), lambda w: F.contains(low, w))
        return F.struct(F.lit(label).alias("label"), (F.size(found) / F.lit(len(own))).alias("confidence"), found.alias("matched"))

    hits = rows.select(key, F.inline(F.array(*(one(k, v) for k, v in words.items())))).filter(F.col("confidence") >= least)
    if not exclusive:
        return hits
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "label")
    return hits.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def set_scores(have: Column, want: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of one set against another; two empty sets agree."""
    both, h, w = F.size(F.array_intersect(have, want)), F.size(F.array_distinct(have)), F.size(F.array_distinct(want))
    empty = (h == 0) & (w == 0)
    p, r = F.when(empty, 1.0).otherwise(ratio(both, h)), F.when(empty, 1.0).otherwise(ratio(both, w))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits, sharpened or flattened by the temperature."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def platt(score: Column, a: float, b: float) -> Column:
    """Sigmoid calibration of a score."""
    return 1 / (1 + F.exp(a * score + b))


def isotonic(rows: DataFrame, score: str, label: str):
    """A fitted monotone calibration (the model of Spark's library)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = VectorAssembler(inputCols=[score], outputCol="__f").transform(rows.withColumn(label, F.col(label).cast("double")))
    return IsotonicRegression(featuresCol="__f", labelCol=label, predictionCol="calibrated").fit(data)


def merge_signals(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], signals: str) -> DataFrame:
    """The best row of each key with the sorted union of all rows' signals."""
    w = Window.partitionBy(*keys)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(signals).over(w))))
    place = F.row_number().over(w.orderBy(*rank))
    return rows.withColumn("__all", every).withColumn("__r", place).filter("__r = 1").withColumn(signals, F.col("__all")).drop("__all", "__r")


def kept_by_recency(rows: DataFrame, cache: str, used: str, size: str, capacity: int, entry: str) -> DataFrame:
    """Entries a cache of a capacity keeps when the least recently used go first."""
    w = Window.partitionBy(cache).orderBy(F.desc(used), entry).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__held", F.sum(size).over(w)).filter(F.col("__held") <= capacity).drop("__held")


def page_bounds(limit: int | None = None, offset: int | None = None, page: int | None = None, per_page: int | None = None, most: int = 500) -> tuple[int, int]:
    """(limit, offset) from either of both ways to ask for a page, held within bounds."""
    if page is not None or per_page is not None:
        size = min(max(per_page or 50, 1), most)
        return size, (max(page or 1, 1) - 1) * size
    return min(max(limit if limit is not None else 50, 1), most), max(offset or 0, 0)
