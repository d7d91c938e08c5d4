"""Joins and windows over entities, fields, regions and relations of documents.

Pair joins carry an equality (document, page) and, where a page may hold very many rows, a bucket of
the offset, so that rows far apart never meet; range conditions are residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    named = rows
    names = []
    for i, k in enumerate(keys):
        names.append(f"__k{i}")
        named = named.withColumn(f"__k{i}", k)
    w = Window.partitionBy(*names).orderBy(*order)
    return named.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", *names)


def renumber(rows: DataFrame, group: Sequence[str], order: Sequence[Column], prefix: str, width: int = 3) -> DataFrame:
    """Adds ``new_id``: the prefix and the row's place in its group, padded but never cut."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("new_id", F.concat(F.lit(prefix), F.format_string(f"%0{width}d", place)))


def gap(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a_begin, b_begin) - F.least(a_end, b_end))


def near_pairs(spans: DataFrame, group: str, farthest: int) -> DataFrame:
    """(group, a_*, b_*, distance) of spans (ordinal, kind, value, begin, end) of a group at most ``farthest`` apart, a before b.

    Spans are put into buckets of ``farthest`` plus the longest span; a pair meets in the buckets where the
    earlier one ends, so that a long document costs its neighbours, not its square.
    """
    size = F.lit(farthest + 1)
    left = spans.select(F.col(group), *(F.col(c).alias(f"a_{c}") for c in spans.columns if c != group))
    right = spans.select(F.col(group), *(F.col(c).alias(f"b_{c}") for c in spans.columns if c != group))
    left = left.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a_begin") / size), F.floor((F.col("a_end") + farthest) / size))))
    right = right.withColumn("bucket", F.floor(F.col("b_begin") / size))
    order = F.struct("a_begin", "a_end", "a_ordinal") < F.struct("b_begin", "b_end", "b_ordinal")
    d = gap(F.col("a_begin"), F.col("a_end"), F.col("b_begin"), F.col("b_end"))
    return left.join(right, [group, "bucket"]).filter(order).withColumn("distance", d).filter(F.col("distance") <= farthest).drop("bucket")


def without_overlap(weaker: DataFrame, stronger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of ``weaker`` that overlap no span of ``stronger`` with the same keys; touching is no overlap."""
    s = stronger.select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("begin").alias("s_begin"), F.col("end").alias("s_end"))
    on = (F.col("begin") < F.col("s_end")) & (F.col("end") > F.col("s_begin"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    return weaker.join(s, on, "left_anti")


def by_priority(tiers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all tiers (equal columns), each tier without the keys of those before it."""
    out = tiers[0].withColumn("tier", F.lit(0))
    seen = tiers[0].select(*keys).distinct()
    for i, tier in enumerate(tiers[1:], 1):
        fresh = tier.join(seen, list(keys), "left_anti")
        out = out.unionByName(fresh.select(*tier.columns).withColumn("tier", F.lit(i)))
        seen = seen.unionByName(fresh.select(*keys).distinct())
    return out


def nearest(left: DataFrame, right: DataFrame, group: str, left_id: str, position: str, right_id: str, right_position: str) -> DataFrame:
    """(group, left_id, right_id, distance): of each left row the right row of the group at the least distance; ties by id.

    Only distinct positions are compared, each with its neighbour before and after, so that a group that
    holds a large part of all rows costs its positions, not its pairs.
    """
    r = right.filter(F.col(right_position).isNotNull()).groupBy(group, F.col(right_position).alias("at")).agg(F.min(right_id).alias("id"))
    here = left.filter(F.col(position).isNotNull()).select(group, F.col(position).alias("at")).distinct()
    point = F.when(F.col("id").isNotNull(), F.struct("at", "id"))
    every = here.join(r, [group, "at"], "full_outer").withColumn("p", point)
    w = Window.partitionBy(group).orderBy("at")
    before = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # null structs compare first, so each side is only offered where it exists
    choice = lambda p: F.when(p.isNotNull(), F.struct(F.abs(p["at"] - F.col("at")).alias("d"), p["id"].alias("i")))
    best = F.array_min(F.array_compact(F.array(choice(F.col("before")), choice(F.col("after")))))
    near = every.withColumns({"before": before, "after": after}).withColumn("b", best).filter("b is not null").select(F.col(group).alias("__g"), F.col("at").alias("__at"), "b")
    rows = left.select(group, left_id, F.col(position).alias("__p")).distinct()
    return rows.join(near, (F.col(group) == F.col("__g")) & (F.col("__p") == F.col("__at"))).select(group, left_id, F.col("b.i").alias(right_id), F.col("b.d").alias("distance"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, payload: Sequence[str], bucket_seconds: int = 86400) -> DataFrame:
    """Left rows with the payload of the right row of the key that is the latest not after them.

    Each key's rows are sorted within buckets of time, so that a key with very many rows is many tasks'
    work; what holds at a bucket's beginning comes from a table of one row per key and bucket.
    """
    cols = left.columns
    kind = right.select(F.struct(*payload).alias("p")).schema[0].dataType
    bucket = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / bucket_seconds)
    l = left.select(*cols, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__p"))
    r = right.select(*(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*payload).alias("__p"))
    both = l.unionByName(r).withColumn("__b", bucket("__t"))
    inside = F.last("__p", ignorenulls=True).over(Window.partitionBy(key, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(key, "__b").agg(F.max_by("__p", F.when(F.col("__side") == 0, F.col("__t"))).alias("__last"))
    carried = F.last("__last", ignorenulls=True).over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    start = ends.withColumn("__start", carried).select(F.col(key).alias("__k"), F.col("__b").alias("__c"), "__start")
    found = both.withColumn("__in", inside).filter("__side = 1").join(start, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c")), "left")
    p = F.coalesce("__in", "__start")
    return found.withColumn("__q", F.when(F.col(key).isNotNull(), p)).select(*cols, *(F.col(f"__q.{c}").alias(c) for c in payload))


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes (x1, y1, x2, y2) overlap by more than an edge."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x1") < c(b, "x2")) & (c(b, "x1") < c(a, "x2")) & (c(a, "y1") < c(b, "y2")) & (c(b, "y1") < c(a, "y2"))


def centre_in(point: str, box: str) -> Column:
    """Whether the centre of one box lies in another, edges included."""
    c = lambda t, n: F.col(f"{t}.{n}")
    x, y = (c(point, "x1") + c(point, "x2")) / 2, (c(point, "y1") + c(point, "y2")) / 2
    return x.between(c(box, "x1"), c(box, "x2")) & y.between(c(box, "y1"), c(box, "y2"))
