"""Percentile definitions, guarded ratios and vector scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole``, or ``empty`` where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def percentile_linear(value: Column, p: float) -> Column:
    """Interpolates between the neighbours of position (n - 1) p."""
    return F.percentile(value, p)


def percentile_nearest_rank(value: Column, p: float) -> Column:
    """The value at rank ceil(p n); null for no values."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.greatest(F.ceil(F.size(ordered) * p).cast("int") - 1, F.lit(0)))


def percentile_floor_index(value: Column, p: float) -> Column:
    """The value at index min(int(n p), n - 1); null for no values."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * p).cast("int"), F.size(ordered) - 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null or zero or their lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def coefficient_of_variation(value: Column) -> Column:
    """Population deviation over mean; 0 for fewer than two values or a zero mean."""
    return F.when((F.count(value) > 1) & (F.avg(value) != 0), F.stddev_pop(value) / F.avg(value)).otherwise(F.lit(0.0))
