from docan.llm import key_filter as k


def test_filter_misses_no_key(spark):
    rows = spark.range(20000).selectExpr("id", "id % 7 as other")
    keys = rows.filter("id % 10 = 0").select("id")
    bits = k.key_filter(keys, "id")
    got = {r["id"] for r in k.possible(rows, bits, "id").collect()}
    assert got >= set(range(0, 20000, 10)) and len(got) < 2200
    assert k.possible(rows, k.key_filter(keys.limit(0), "id"), "id").count() == 0
    assert k.key_filter(rows, "id").count() <= k.BITS // 64


def test_distinct_by(spark):
    data = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "z"), (None, "z")]
    got = sorted((r[0] or "", r[1]) for r in k.distinct_by(spark.createDataFrame(data, "key string, t string"), "key").collect())
    assert got == [("", "z"), ("a", "x"), ("a", "y"), ("b", "x")]
