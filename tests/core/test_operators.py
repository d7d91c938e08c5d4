import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docan.functions import numbers, texts
from docan.operators import analytics, custody, extraction, linking, pages, rollups, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentiles(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = df.agg(numbers.percentile_linear(F.col("v"), 0.95).alias("a"), numbers.percentile_nearest_rank(F.col("v"), 0.5).alias("b"), numbers.percentile_floor_index(F.col("v"), 0.5).alias("c")).first()
    assert row["a"] == pytest.approx(8.95) and row["b"] == 2.0 and row["c"] == 3.0
    empty = df.limit(0).agg(numbers.percentile_nearest_rank(F.col("v"), 0.5).alias("b"), numbers.percentile_floor_index(F.col("v"), 0.5).alias("c")).first()
    assert empty["b"] is None and empty["c"] is None


def test_series_has_empty_and_cut_buckets(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:05",), ("2025-01-01 00:00:25",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    rows = analytics.series(df, "ts", "2025-01-01 00:00:00", "2025-01-01 00:00:25", 10, [F.count(F.lit(1)).alias("n")]).orderBy("bucket_start").collect()
    assert [r["n"] for r in rows] == [1, 0, 0] and (rows[-1]["bucket_end"] - rows[-1]["bucket_start"]).seconds == 5


def brute_chunks(total, existing, size):
    missing = [p for p in range(1, total + 1) if p not in existing]
    out = []
    for p in missing:
        if out and out[-1][1] == p - 1 and p - out[-1][0] < size:
            out[-1][1] = p
        else:
            out.append([p, p])
    return sorted(map(tuple, out))


def test_missing_chunks(spark):
    rng = random.Random(4)
    cases = {i: (rng.randint(0, 40), sorted({rng.randint(-2, 45) for _ in range(rng.randint(0, 30))}), 7) for i in range(60)}
    totals = spark.createDataFrame([(i, n) for i, (n, _, _) in cases.items()], "k long, n int")
    existing = spark.createDataFrame([(i, p) for i, (_, e, _) in cases.items() for p in e + e[:1]], "k long, p int")
    got = {}
    for r in pages.missing_chunks(totals, existing, "k", "n", "p", 7).collect():
        got.setdefault(r["k"], []).append((r["first"], r["last"]))
    for i, (n, e, size) in cases.items():
        assert sorted(got.get(i, [])) == brute_chunks(n, set(e), size)


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_chunks_cover_the_text(text, size, overlap):
    parts = extraction.chunk_bounds(text, size, overlap, 10)
    covered = set()
    for a, b in parts:
        assert 0 < b - a <= size
        covered |= set(range(a, b))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered
    assert [a for a, _ in parts] == sorted(a for a, _ in parts)


def test_near_pairs_against_all(spark):
    rng = random.Random(1)
    rows = [("d", i, "k", f"v{i}", a, a + rng.randint(1, 60)) for i, a in enumerate(rng.randint(0, 900) for _ in range(60))]
    df = spark.createDataFrame(rows, "d string, ordinal int, kind string, value string, begin int, end int")
    got = {frozenset((r["a_value"], r["b_value"])): r["distance"] for r in linking.near_pairs(df, "d", 40).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[3] < y[3]:
                d = max(0, max(x[4], y[4]) - min(x[5], y[5]))
                if d <= 40:
                    want[frozenset((x[3], y[3]))] = d
    assert got == want


def test_nearest_and_as_of(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), i, rng.randint(0, 50)) for i in range(40)]
    right = [(rng.choice("ab"), 100 + i, rng.randint(0, 50)) for i in range(15)]
    l = spark.createDataFrame(left, "g string, id long, at long")
    r = spark.createDataFrame(right, "g string, rid long, rat long")
    got = {x["id"]: (x["distance"], x["rid"]) for x in linking.nearest(l, r, "g", "id", "at", "rid", "rat").collect()}
    assert got == {i: min((abs(p - q), j) for h, j, q in right if h == g) for g, i, p in left}
    t = lambda c: F.timestamp_seconds(F.col(c) * 40000)
    a = l.select("g", "id", t("at").alias("ts"))
    b = r.groupBy("g", "rat").agg(F.max("rid").alias("rid")).select("g", "rid", t("rat").alias("rts"))
    found = {x["id"]: x["rid"] for x in linking.as_of(a, b, "g", "ts", "rts", ["rid", "rts"]).collect()}
    for g, i, p in left:
        fits = [(q, j) for h, j, q in right if h == g and q <= p]
        assert found[i] == (max(fits)[1] if fits else None)


def test_overlap_and_priority(spark):
    s = "kind string, begin int, end int"
    weak = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("b", 2, 3)], s)
    strong = spark.createDataFrame([("a", 3, 5)], s)
    assert sorted(map(tuple, linking.without_overlap(weak, strong, ["kind"]).collect())) == [("a", 5, 9), ("b", 2, 3)]
    t = [spark.createDataFrame([(k,) for k in x], "k string") for x in ("ab", "bc", "cda")]
    assert sorted(map(tuple, linking.by_priority(t, ["k"]).collect())) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200, None), (201, [0.0] * 8), (202, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = search.top_k(df, df.filter("id % 50 = 0"), "id", "v", 5).collect()

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for q in (0, 50, 100, 150):
        best = sorted(((-cos(rows[q][1], v), i) for i, v in rows if v and len(v) == 8 and i != q))[:5]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in best]


def test_search_filters(spark):
    df = spark.createDataFrame([("PERSON", "A_b", "j1", 0.9), ("PERSON", "Axb", "j2", 0.5), ("ORG", None, "j1", None)], "entity_type string, text string, job_id string, confidence double")
    n = lambda **k: search.entity_search(df, **k).count()
    assert n() == 3 and n(needle="a_B") == 1 and n(allowed=[]) == 0 and n(allowed=[], job="j1") == 2 and n(least=0.6) == 1


def test_chains(spark):
    rows = [(d, "made", f"t{i}", '{"é": 1}' if i % 2 else None, i) for d in "ab" for i in range(5)]
    chain = custody.build(spark.createDataFrame(rows, "document_id string, event_type string, timestamp string, data string, order_key int"))
    ok = custody.verify(chain).collect()
    assert all(r["valid"] and r["events"] == 5 for r in ok) and len(ok) == 2
    bad = chain.withColumn("data", F.when((F.col("document_id") == "a") & (F.col("seq") == 3), "{}").otherwise(F.col("data")))
    assert {(r["document_id"], r["first_break"], r["reason"]) for r in custody.verify(bad).collect()} == {("a", 3, "hash"), ("b", None, None)}
    cut = chain.filter("not (document_id = 'b' and seq = 1)")
    assert {(r["document_id"], r["first_break"], r["reason"]) for r in custody.verify(cut).collect()} == {("a", None, None), ("b", 2, "link")}
    assert custody.event_hash("d", "k", "t", '{"b": 1, "a": "é"}', None) == custody.event_hash("d", "k", "t", '{"a":"\\u00e9","b":1}', None)


@pytest.mark.parametrize("text,iso", [("2024-1-5", "2024-01-05"), ("2024-99-99", "2024-99-99"), ("1/15/2024", "2024-01-15"), ("15 January 2024", "2024-01-15"), ("Jan. 5, 2024", "2024-01-05"), ("5 Foo 2024", "5 Foo 2024"), ("soon", "soon")])
def test_dates(spark, text, iso):
    assert one(spark, extraction.normalise_date(F.lit(text))) == iso


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("d", "\U0001f600 Exhibit A-1 and ABC001234"), ("n", None)], "k string, t string")
    got = {(r["kind"], r["value"], r["begin"], r["end"]) for r in extraction.spans(df, "k", "t", extraction.entity_patterns()).collect()}
    assert ("EXHIBIT_REF", "A-1", 10, 13) in got and ("BATES_NUMBER", "ABC001234", 18, 27) in got


def test_types(spark):
    kind, _ = extraction.best_type(extraction.type_scores(F.col("t")))
    df = spark.createDataFrame([("Invoice. Amount due: 3",), ("memo To: a From: b",), ("memo only",), (None,), ("nothing",)], "t string")
    assert [r[0] for r in df.select(kind).collect()] == ["invoice", "memo", "other", "other", "other"]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edit_distance(a, b):
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i, j] = i or j if not i or not j else min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert texts.edit_distance(a, b) == table[len(a), len(b)]


def test_error_rates():
    assert texts.error_rate("", "") == 0 and texts.error_rate("", "x") == 1 and texts.error_rate("ab", "abcdef") == 2


def test_html():
    rows = texts.table_rows("<p>x</p><table><tr><th>a<td>b<tr><td>c <b>d</b><script>no</script></td></table>")
    assert rows == [[["a", "b"], ["c d"]]]


def test_text_columns(spark):
    assert one(spark, texts.sanitise(F.lit('<div><table class="x"><tr onclick="y"><td>1</td></tr></table><script>bad()</script></div>'))) == "<table><tr><td>1</td></tr></table>"
    assert one(spark, texts.merge_paragraphs(F.lit("the rest of the con- ".strip()), F.lit("tract"))) == "the rest of the contract"
    assert one(spark, texts.apply_glossary(F.lit("aab"), [("a", "b"), ("bb", "c")])) == "cb"
    assert one(spark, texts.escape_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert one(spark, texts.character_error_rate(F.lit("abcd"), F.lit("abed"))) == 0.25
    assert one(spark, texts.evidence(F.lit("x" * 50 + " the  word " + "y" * 50), F.lit(56), F.lit(60))).startswith("x")
    assert one(spark, texts.normal_form("NFC")(F.lit("é"))) == "é"


def test_summary():
    text = "The harbour was closed today. Nobody knows the number. The harbour office closed the gate today. A gate of the harbour was closed. Zebras are animals too. Short."
    assert texts.rank_sentences(text, 2) == [s for s in texts.rank_sentences(text, 2) if "harbour" in s] and len(texts.rank_sentences(text, 2)) == 2
    assert texts.rank_sentences(None) == []


def test_class_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b"), ("c", None)], "t string, g string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in rollups.class_scores(df, "t", "g").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, 0.333333, 1.0), "c": (1, 0.0, 0.0)}


def test_reliability(spark):
    df = spark.createDataFrame([(1.0, 1), (-0.5, 0), (0.95, 0), (None, 1)], "p double, y int")
    assert {r["bin"]: r["n"] for r in rollups.reliability(df, "p", F.col("y")).collect()} == {9: 2, 0: 1}


def test_calibration_error_of_a_tie(spark):
    scores = [0.0138, 0.0583, 0.0868, 0.0822, 0.0783, 0.0065, 0.0262, 0.0]  # their mean is 0.0440125
    error = lambda rows, kind="boolean": rollups.calibration_error(rollups.reliability(spark.createDataFrame(rows, f"p double, y {kind}").coalesce(1), "p", F.col("y"))).first()["ece"]
    assert {error([(p, False) for p in order]) for order in (scores, scores[::-1], sorted(scores))} == {0.044013}
    assert error([(p, 0) for p in scores], "int") == 0.044013
    assert error([(0.3, None), (0.35, True)]) == 0.675 and error([]) is None and error([(0.3, None)]) is None
    assert error([(1e30, True), (0.2, False)]) == 5e29 and error([(float("nan"), True)]) != error([(float("nan"), True)])


def test_languages(spark):
    df = spark.createDataFrame([("d", "de", 10, 1.0), ("d", "fr", 10, 0.5)], "d string, l string, n int, c double")
    shares = rollups.language_shares(df, ["d"], "l", F.col("n"), "c")
    assert rollups.main_language(shares, ["d"], "l").first()["l"] == "fr"
