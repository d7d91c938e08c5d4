import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docan.sources import files
from docan.streaming import metrics


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.PDF").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "y.jpg").write_bytes(b"\xff\xd8\xff\xe0....")
    (tmp_path / "z.txt").write_text("no")
    got = {(r["extension"], r["family"]) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {("pdf", "pdf"), ("jpg", "image")}
    assert {r["extension"]: r["files"] for r in files.manifest(files.digest_files(spark, str(tmp_path))).collect()} == {"pdf": 1, "jpg": 1, "txt": 1}


def test_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"timestamp":"2025-01-01T00:00:00Z","level":"error","m":"a"}\n\n{"timestamp":"never","level":"odd"}\nbroken\n{"timestamp":"2024-01-01T00:00:00Z","level":"info"}\n')
    rows = files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "timestamp string, level string, m string")
    assert rows.count() == 4 and rows.filter("m is null").count() == 3
    assert files.filter_log(rows, since="2024-06-01 00:00:00").count() == 3
    assert files.filter_log(rows, least_level="WARNING").count() == 1


def test_failures(spark, tmp_path):
    (tmp_path / "old.csv").write_text("Timestamp,SourcePath,PageNum,Error\nt,a.pdf,3,blank page\n")
    (tmp_path / "new.csv").write_text(",".join(files.NEW_FAILURES) + '\nt,b.pdf,x,"say ""no""",critical,failed,1,300,,\nt,c.pdf,1,e,ocr_text,failed,3,300,,\n')
    old, new = files.read_failures(spark, str(tmp_path / "old.csv")), files.read_failures(spark, str(tmp_path / "new.csv"))
    assert old.first()["FailureType"] == "unknown" and old.first()["PageNum"] == 3
    assert [r["Error"] for r in new.orderBy("SourcePath").collect()] == ['say "no"', "e"]
    assert [r["SourcePath"] for r in files.retriable(old.unionByName(new)).collect()] == ["a.pdf"]


def test_sidecars(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1, None), ("d2", None, "é")], "doc string, n int, s string")
    for _ in range(2):
        files.write_sidecars(df, str(tmp_path / "s"), "doc", "ner")
    files.write_sidecars(df.limit(1), str(tmp_path / "s"), "doc", "other")
    back = files.read_sidecars(spark, str(tmp_path / "s"), "ner", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert files.missing_columns(df, T.StructType([T.StructField("doc", T.StringType()), T.StructField("x", T.LongType()), T.StructField("n", T.LongType())])) == ["x", "n"]
    assert files.markdown(df, "doc", "doc", ["n", "s"]).first()["markdown"].startswith("# d1\n\n| field | value |")
    pairs = files.pair_by_stem(spark.createDataFrame([("/a/x.txt",)], "path string"), spark.createDataFrame([("/b/x.json",), ("/b/y.json",)], "path string"))
    assert pairs.first()["other_path"] == "/b/x.json" and pairs.count() == 1


def feed(spark, tmp_path, name, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return metrics.follow(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema, 1)


def at(minute):
    return dt.datetime(2025, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_stream_equals_batch(spark, tmp_path):
    parts = [[(at(m), float(m)) for m in range(a, a + 200, 3)] for a in (0, 200, 400)]
    stream = feed(spark, tmp_path, "in", parts, "ts timestamp, v double")
    got = {tuple(r) for r in metrics.run_to_end(metrics.windowed(stream, "ts", "v", "10 minutes", watermark="20 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    batch = {tuple(r) for r in metrics.windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "v", "10 minutes").collect()}
    assert got <= batch and len(got) >= len(batch) - 4


def test_alerts(spark, tmp_path):
    depths = [[("q", at(0), 5), ("q", at(1), 60), ("q", at(2), 70), ("q", at(3), 120)], [("q", at(4), 130), ("q", at(5), 10), ("q", at(6), 60)]]
    stream = feed(spark, tmp_path, "depth", [sum(depths, [])], "queue string, ts timestamp, depth long")
    rows = metrics.run_to_end(metrics.alerts(stream, 50, 100), str(tmp_path / "alerts"), str(tmp_path / "cp2")).collect()
    got = sorted((r["ts"].minute, r["severity"], r["state"]) for r in rows)
    assert got == [(1, "warning", "FIRING"), (3, "critical", "FIRING"), (5, "critical", "RESOLVED"), (5, "warning", "RESOLVED"), (6, "warning", "FIRING")]


def test_completion(spark, tmp_path):
    stream = feed(spark, tmp_path, "pages", [[("a", 1, 2), ("b", 1, 3), ("a", 1, 2)], [("a", 2, 2), ("a", 2, 2)], [("b", 3, 3)]], "document_id string, page long, total long")
    rows = metrics.run_to_end(metrics.completed(stream), str(tmp_path / "done"), str(tmp_path / "cp3")).collect()
    assert [tuple(r) for r in rows] == [("a", 2)]


def test_workers_and_retention(spark):
    beats = spark.createDataFrame([("w", at(0)), ("w", at(5)), ("x", at(9))], "worker string, ts timestamp")
    got = {r["worker"]: r["offline"] for r in metrics.stale_workers(beats, "2025-01-01 00:09:30", 120).collect()}
    assert got == {"w": True, "x": False}
    assert metrics.retained(beats, "ts", "2025-01-01 01:00:00", 1).count() == 2
    assert metrics.once(beats.withColumn("k", F.lit(1)), "k", "ts").count() == 1
