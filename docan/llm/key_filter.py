"""Filters of keys whose size does not depend on how many keys there are.

A filter holds one bit for each of ``BITS`` hash values and is a table of at most ``BITS / 64`` rows of two
numbers, so it may be broadcast whatever the data: 2 MB. It never misses a key. What it lets through by
chance, the exact join or aggregation that follows sorts out; it only spares moving what cannot matter.

Defined results: null keys hash like any other value; an empty set of keys lets nothing through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def _hash(columns: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*(F.col(c) for c in columns)), F.lit(BITS))


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """(__slot, __bits) of the keys in ``columns``."""
    rows = keys.select(_hash(columns).alias("__h"))
    return rows.groupBy(F.expr("cast(__h div 64 as int)").alias("__slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__h % 64 as int))")).alias("__bits"))


def marked(rows: DataFrame, keys: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with a column that is true where the key may be among ``keys`` (a filter), by its own ``columns``."""
    h = rows.withColumn("__h", _hash(columns)).withColumn("__slot", F.expr("cast(__h div 64 as int)"))
    joined = h.join(F.broadcast(keys), "__slot", "left")  # at most BITS / 64 rows
    bit = F.expr("shiftrightunsigned(__bits, cast(__h % 64 as int)) & 1L")
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__h", "__slot", "__bits")


def possible(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Those of ``rows`` whose key may be among ``keys`` (a filter)."""
    return marked(rows, keys, columns, "__may").filter("__may").drop("__may")


def distinct_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, where rows can only be equal if ``columns`` are; only rows whose key repeats are moved."""
    twice = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    both = marked(rows, key_filter(twice, *columns), columns, "__may")
    return both.filter("not __may").drop("__may").unionByName(both.filter("__may").drop("__may").distinct())
