import pytest
from pyspark.sql import functions as F

from docan.operators import labels, layout


def test_columns_and_order(spark):
    assert layout.columns_of([90, 10, 92, 12, 50], 5) == [0, 2, 0, 2, 1]
    rows = [("d", 1, f"s{i}", [x, y, x + 10.0, y + 50.0]) for i, (x, y) in enumerate([(80.0, 60.0), (80.0, 0.0), (10.0, 0.0)])]
    df = spark.createDataFrame(rows, "doc string, page int, line string, b array<double>").withColumn("box", layout.flat_box(F.col("b")))
    got = {r["line"]: (r["column"], r["place"]) for r in layout.vertical_order(df, ["doc", "page"], "line", "box", 100.0).collect()}
    assert got == {"s1": (0, 0), "s0": (0, 1), "s2": (1, 2)}
    assert layout.direction(df, ["doc", "page"], "box").first()["direction"] == "vertical"


def test_boxes(spark):
    row = spark.range(1).select(layout.polygon_box(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in [(1.0, 2.0), (5.0, 1.0), (4.0, 7.0)]))).alias("b"), layout.flat_box(F.array(F.lit(1.0))).alias("n")).first()
    assert tuple(row["b"]) == (1.0, 1.0, 5.0, 7.0) and row["n"] is None


@pytest.mark.parametrize("frames,fps,plan", [(100, 10.0, [0, 20, 40, 60, 80, 99]), (0, 25.0, []), (3, 25.0, [0, 2]), (1000, 10.0, [0, 160, 340, 500, 660, 840, 999])])
def test_frames(spark, frames, fps, plan):
    got = spark.range(1).select(layout.frame_plan(F.lit(frames), F.lit(fps), 2.0, 7).alias("p")).first()["p"]
    assert got[0:1] == plan[0:1] and got[-1:] == plan[-1:] and len(got) == len(plan)


def test_bio(spark):
    tags = ["B-a", "I-a", "O", "I-b", "I-b", "B-b", "I-a"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(tags)], "d string, i int, t string")
    spans = labels.bio_spans(df, "d", "i", "t")
    assert {(r["type"], r["begin"], r["end"]) for r in spans.collect()} == {("a", 0, 1), ("b", 3, 4), ("b", 5, 5), ("a", 6, 6)}
    other = spans.filter("begin < 5").unionByName(spark.createDataFrame([("d", "c", 0, 0)], "d string, type string, begin int, end int"))
    got = {r["type"]: (r["support"], r["precision"], r["recall"]) for r in labels.span_scores(spans, other, "d").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (2, 1.0, 0.5), "c": (0, 0.0, 0.0)}


def test_taxonomy_and_sets(spark):
    df = spark.createDataFrame([(1, "Cargo at the HARBOUR"), (2, None)], "k int, t string")
    words = {"ship": ["harbour", "cargo"], "sea": ["harbour", "wave"]}
    assert {(r["k"], r["label"]) for r in labels.taxonomy(df, "k", "t", words).collect()} == {(1, "ship"), (1, "sea")}
    assert [r["label"] for r in labels.taxonomy(df, "k", "t", words, exclusive=True).collect()] == ["ship"]
    p, r, f = labels.set_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))
    assert tuple(spark.range(1).select(p, r, f).first()) == pytest.approx((0.5, 1.0, 2 / 3))


def test_calibration(spark):
    row = spark.range(1).select(labels.softmax(F.array(F.lit(1.0), F.lit(1.0)), 2.0).alias("s"), labels.platt(F.lit(0.0), -1.0, 0.0).alias("p")).first()
    assert row["s"] == [0.5, 0.5] and row["p"] == 0.5
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "s double, y int")
    out = labels.isotonic(df, "s", "y")
    assert out.boundaries.size >= 2


def test_signals_cache_pages(spark):
    df = spark.createDataFrame([("r", 1, ["b"]), ("r", 2, ["a", "b"]), ("q", 1, None)], "k string, p int, s array<string>")
    got = {r["k"]: (r["p"], r["s"]) for r in labels.merge_signals(df, ["k"], [F.desc("p")], "s").collect()}
    assert got["r"] == (2, ["a", "b"])
    cache = spark.createDataFrame([("c", 1, 5, "x"), ("c", 2, 5, "y"), ("c", 3, 5, "z")], "c string, used int, size int, e string")
    assert {r["e"] for r in labels.kept_by_recency(cache, "c", "used", "size", 10, "e").collect()} == {"y", "z"}
    assert labels.page_bounds(page=3, per_page=20) == (20, 40) and labels.page_bounds() == (50, 0) and labels.page_bounds(limit=9999, offset=-5) == (500, 0)
