"""Geometry of lines on pages: boxes, spacing, columns and reading order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docan.functions.numbers import coefficient_of_variation


def flat_box(box: Column) -> Column:
    """(x1, y1, x2, y2) of a box given as four numbers; null where it has fewer."""
    return F.when(F.size(box) >= 4, F.struct(*(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))


def polygon_box(points: Column) -> Column:
    """Enclosing (x1, y1, x2, y2) of an array of (x, y) arrays."""
    side = lambda i: F.transform(points, lambda p: p[i])
    return F.struct(F.array_min(side(0)).alias("x1"), F.array_min(side(1)).alias("y1"), F.array_max(side(0)).alias("x2"), F.array_max(side(1)).alias("y2"))


def spacing(lines: DataFrame, page: Sequence[str], box: str) -> DataFrame:
    """(page, lines, spacing_cv, height_cv): variation of the gaps between lines from top to bottom, and of their heights."""
    w = Window.partitionBy(*page).orderBy(f"{box}.y1", f"{box}.x1")
    gap = F.col(f"{box}.y1") - F.lag(f"{box}.y2").over(w)
    rows = lines.withColumn("__gap", F.when(gap > 0, gap)).withColumn("__h", F.col(f"{box}.y2") - F.col(f"{box}.y1"))
    return rows.groupBy(*page).agg(F.count(F.lit(1)).alias("lines"), coefficient_of_variation(F.col("__gap")).alias("spacing_cv"), coefficient_of_variation(F.col("__h")).alias("height_cv"))


def vertical(box: str, aspect: float = 2.0) -> Column:
    """Whether a line is much taller than wide; a box without width is not."""
    w, h = F.col(f"{box}.x2") - F.col(f"{box}.x1"), F.col(f"{box}.y2") - F.col(f"{box}.y1")
    return F.coalesce((w > 0) & (h / F.nullif(w, F.lit(0.0)) >= aspect), F.lit(False))


def direction(lines: DataFrame, page: Sequence[str], box: str, mostly: float = 0.6, partly: float = 0.2) -> DataFrame:
    """(page, direction): ``vertical`` from ``mostly`` on, ``mixed`` from ``partly`` on, else ``horizontal``."""
    share = F.avg(vertical(box).cast("double"))
    return lines.groupBy(*page).agg(F.when(share >= mostly, "vertical").when(share >= partly, "mixed").otherwise("horizontal").alias("direction"))


def columns_of(centres: Sequence[float], tolerance: float) -> list[int]:
    """Column number of each centre: from the right, a line joins the column whose running mean is near enough."""
    means: list[list[float]] = []
    found = [0] * len(centres)
    for i in sorted(range(len(centres)), key=lambda k: (-centres[k], k)):
        for c, m in enumerate(means):
            if abs(m[0] / m[1] - centres[i]) <= tolerance:
                m[0] += centres[i]
                m[1] += 1
                found[i] = c
                break
        else:
            means.append([centres[i], 1])
            found[i] = len(means) - 1
    return found


def vertical_order(lines: DataFrame, page: Sequence[str], line: str, box: str, page_width: float, tolerance: float = 0.05) -> DataFrame:
    """(page, line, column, place): reading order of vertical text, columns from the right, lines from the top.

    Clustering by a running mean depends on order, hence a fold; its group is one page.
    """
    kinds = dict(lines.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*page, line)), "column int, place int"])
    flat = lines.select(*page, line, ((F.col(f"{box}.x1") + F.col(f"{box}.x2")) / 2).alias("centre"), F.col(f"{box}.y1").alias("top"))

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(line).reset_index(drop=True)
        frame["column"] = columns_of(frame["centre"].tolist(), tolerance * page_width)
        frame = frame.sort_values(["column", "top", line], kind="stable").reset_index(drop=True)
        frame["place"] = range(len(frame))
        return frame[[*page, line, "column", "place"]].astype({"column": "int32", "place": "int32"})

    return flat.filter("centre is not null and top is not null").groupBy(*page).applyInPandas(order, schema)


def frame_plan(frames: Column, fps: Column, seconds: float, most: int) -> Column:
    """Frames of a video to look at: every so many seconds and the last; thinned to ``most`` with both ends kept."""
    stride = F.greatest(F.lit(1), F.bround(fps * seconds).cast("int"))
    every = F.when(frames > 0, F.array_distinct(F.concat(F.sequence(F.lit(0), frames - 1, stride), F.array(frames - 1)))).otherwise(F.array().cast("array<int>"))
    n = F.size(every)
    thin = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(every, F.bround(i * (n - 1) / F.lit(max(most - 1, 1))).cast("int"))))
    return F.when(n <= most, every).otherwise(thin)
