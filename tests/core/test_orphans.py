import datetime as dt

from docan.operators import orphans as o


def at(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


JOBS = "job_id string, loaded_at timestamp, at timestamp, key string"


def tables(spark):
    jobs = spark.createDataFrame([("a", at(1), None, "x"), ("A ", at(9), None, "x"), ("b", at(5), None, "x"), ("c", None, None, "x"), (None, at(1), None, "x"), ("p", at(1), None, "x")], JOBS)
    purges = spark.createDataFrame([(" P", at(4)), ("gone", at(2)), ("b", None), ("late", at(30))], "job_id string, purged_at timestamp")
    rows = [("1", " a", at(2)), ("2", "b", at(2)), ("3", "b", at(5)), ("4", "c", at(1)), ("5", "zzz", at(3)), ("6", None, at(3)), ("7", " ", at(3)), ("8", "p", at(3)), ("9", "P", at(4)), ("10", "gone", at(3)), ("11", "zzz", None), ("5", "zzz", at(3)), ("12", "late", at(3)), (None, "zzz", at(3))]
    child = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "row_id string, job_id string, t timestamp, key string, cause int")
    return jobs, purges, child


def test_direct(spark):
    jobs, purges, child = tables(spark)
    states = o.key_states(jobs, "job_id", "loaded_at", purges)
    got = {(r["ref_id"], r["cause"]) for r in o.direct_orphans(child, "row_id", "job_id", "t", states).collect()}
    assert got == {("2", "later"), ("5", "missing"), ("9", "deleted"), ("10", "deleted"), ("11", "missing"), ("12", "missing"), (None, "missing")}


def test_text_times(spark):
    jobs, purges, _ = tables(spark)
    child = spark.createDataFrame([("1", "b", "2025-01-05T01:00:00+02:00"), ("2", "b", "2025-01-05T02:00:00Z"), ("3", "b", "nonsense")], "id string, job_id string, t string")
    states = o.key_states(jobs, "job_id", "loaded_at", purges)
    assert {r["ref_id"] for r in o.direct_orphans(child, "id", "job_id", "t", states).collect()} == {"1"}


def test_empty(spark):
    jobs, purges, child = tables(spark)
    states = o.key_states(jobs.limit(0), "job_id", "loaded_at", None)
    assert o.direct_orphans(child, "row_id", "job_id", "t", states).select("ref_id").distinct().count() == 11
    assert o.direct_orphans(child.limit(0), "row_id", "job_id", "t", states).count() == 0


def test_cascade_and_report(spark):
    a = spark.createDataFrame([("a1",), ("a2",)], "id string")
    b = spark.createDataFrame([("b1", "a1"), ("b2", "zz"), ("b3", None)], "id string, a string")
    c = spark.createDataFrame([("c1", "b1"), ("c2", "B2"), ("c3", "b3"), ("c4", "none")], "id string, b string")
    d = spark.createDataFrame([("d1", "c2"), ("d2", "c1"), ("d3", "c4")], "id string, c string")
    refs = [o.Reference("b", "id", "a", None, "a", "id"), o.Reference("c", "id", "b", None, "b", "id"), o.Reference("d", "id", "c", None, "c", "id")]
    found = o.cascade({"a": a, "b": b, "c": c, "d": d}, refs)
    assert {(r["ref_table"], r["ref_id"], r["kind"]) for r in found.collect()} == {("b", "b2", "direct"), ("c", "c4", "direct"), ("c", "c2", "inherited"), ("d", "d1", "inherited"), ("d", "d3", "inherited")}
    report = {(r["ref_table"], r["month"], r["kind"], r["cause"]): r["orphans"] for r in o.report(found).collect()}
    assert report["d", None, "inherited", "parent"] == 2


def test_cascade_with_a_cycle_ends(spark):
    t = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "9"), ("4", "5"), ("5", "4")], "id string, up string")
    found = o.cascade({"t": t}, [o.Reference("t", "id", "up", None, "t", "id")])
    assert {(r["ref_id"], r["kind"]) for r in found.collect()} == {("3", "direct"), ("2", "inherited"), ("1", "inherited")}


def test_cascade_by_another_key_than_the_id(spark):
    pages = spark.createDataFrame([("p1", "gone", "gone:1"), ("p2", "d", " D:1"), ("p3", None, "d:2")], "page_id string, doc string, place string")
    spans = spark.createDataFrame([("s1", "GONE:1"), ("s2", "d:1"), ("s3", "d:9"), ("p1", "d:2")], "span string, place string")
    refs = [o.Reference("pages", "page_id", "doc", None, "docs", "doc"), o.Reference("spans", "span", "place", None, "pages", "place")]
    found = o.cascade({"docs": spark.createDataFrame([("d",)], "doc string"), "pages": pages, "spans": spans}, refs)
    assert {(r["ref_table"], r["ref_id"], r["kind"]) for r in found.collect()} == {("pages", "p1", "direct"), ("spans", "s3", "direct"), ("spans", "s1", "inherited")}


def test_hot_keys_are_dealt_out(spark):
    rows = o.referring_rows(spark.createDataFrame([(str(i), "Hot" if i % 4 else f"k{i}") for i in range(80)], "id string, up string"), "id", "up", None)
    hot = o.hot_keys(rows, 20)
    assert {(r["key"], r["pieces"]) for r in hot.collect()} == {("hot", 3)}
    keys = spark.createDataFrame([("hot",), ("k4",)], "key string")
    assert o.dealt_join(rows, keys, hot, "left_semi").count() == 61 and o.dealt_join(rows, keys, hot, "left").count() == 80
    assert o.dealt_join(rows, keys, hot, "left").columns == ["key", "ref_id", "at"]


def test_dealing_changes_no_result(spark):
    up = [(f"{level}{i}", f"{'abc'['bcd'.index(level)]}{i % 3}") for level in "bcd" for i in range(12)]
    tables = {t: spark.createDataFrame([u for u in up if u[0][0] == t], "id string, up string") for t in "bcd"} | {"a": spark.createDataFrame([("a0",), ("a1",)], "id string")}
    refs = [o.Reference(t, "id", "up", None, "abc"["bcd".index(t)], "id") for t in "bcd"]
    want = {("b", f"b{i}", "direct") for i in (2, 5, 8, 11)} | {(t, f"{t}{i}", "inherited") for t in "cd" for i in (2, 5, 8, 11)}
    for piece_rows in (1, 3, o.PIECE_ROWS):
        got = [(r["ref_table"], r["ref_id"], r["kind"]) for r in o.cascade(tables, refs, piece_rows=piece_rows).collect()]
        assert set(got) == want and len(got) == len(want)


def test_registered_query_has_inherited_orphans_on_two_levels(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["p4_inherited"](spark, "/root/testdata/sf0.001").groupBy("ref_table", "kind").count().collect()
    assert {(r["ref_table"], r["kind"]) for r in rows} == {("customer", "direct"), ("orders", "inherited"), ("lineitem", "inherited")}
