"""Joins, windows, sets and searches over entities, pages and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docan.operators import extraction as x
from docan.operators import linking as l
from docan.operators import pages as g
from docan.operators import search as s
from docan.plans.analytics_queries import _JOBS, jobs
from docan.plans.extraction_queries import _texts
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()
q = registry.query

_ENTITY = "(SELECT DISTINCT entity_id, job_id, entity_type, text, confidence, source, page, document_name, indexed_at FROM indexed_entities)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "indexed_entities").distinct()


@q("s01_entity_search", f"SELECT entity_id, text, confidence FROM {_ENTITY} WHERE entity_type = 'PERSON' AND contains(lower(text), 'ma') AND confidence >= 0.8 AND job_id IN (SELECT job_id FROM jobs WHERE status = 'completed') ORDER BY confidence DESC, entity_id LIMIT 50 OFFSET 10")
def s01_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 after the first 10, which is the feature."""
    allowed = table(spark, sf_dir, "jobs", "job_id", "status").filter("status = 'completed'").select("job_id").distinct()
    found = s.entity_search(entities(spark, sf_dir), "PERSON", "ma", allowed=allowed, least=0.8)
    return s.page_of(found.select("entity_id", "text", "confidence"), [F.desc("confidence"), F.asc("entity_id")], 50, 10)


@q("s02_entity_total", f"SELECT count(*) AS total FROM {_ENTITY} WHERE entity_type = 'ORG' AND contains(lower(text), 'and_')")
def s02_entity_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wildcard of LIKE is literal."""
    return s.entity_search(entities(spark, sf_dir), "ORG", "and_").agg(F.count(F.lit(1)).alias("total"))


@q(
    "s06_jobs",
    f"""{_JOBS} SELECT job_key, status, priority FROM (SELECT lower(trim(job_id)) AS job_key, status, priority, created_at FROM job WHERE status IN ('failed', 'processing') AND created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00' AND source_file ILIKE '%.pdf%')
ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'normal' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, created_at DESC NULLS LAST, job_key LIMIT 40""",
)
def s06_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).filter(F.col("status").isin("failed", "processing") & F.col("created_at").between(F.lit("2025-03-01").cast("timestamp"), F.lit("2026-03-01").cast("timestamp")) & F.col("source_file").ilike("%.pdf%"))
    rank = F.when(F.col("priority") == "urgent", 0).when(F.col("priority") == "normal", 1).when(F.col("priority") == "low", 2).otherwise(3)
    return s.page_of(rows, [rank.asc(), F.desc_nulls_last("created_at"), F.asc("job_key")], 40).select("job_key", "status", "priority")


@q("s08_replay", "SELECT DISTINCT event_id, seq, event_type FROM job_events WHERE seq > (SELECT coalesce(max(seq), 0) FROM job_events WHERE event_id = (SELECT min(event_id) FROM job_events)) AND delivered_at IS NULL")
def s08_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undelivered events after a given one; an unknown id means from the start."""
    rows = table(spark, sf_dir, "job_events", "event_id", "seq", "event_type", "delivered_at")
    since = rows.join(F.broadcast(rows.agg(F.min("event_id").alias("event_id"))), "event_id").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("since"))  # one row each
    return rows.crossJoin(F.broadcast(since)).filter("seq > since and delivered_at is null").select("event_id", "seq", "event_type").distinct()


@q(
    "k01_nearest_vectors",
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query_id, a.vec_id AS id, list_cosine_similarity(q.v, a.v) AS score FROM a q, a WHERE q.vec_id % 50 = 0 AND q.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) SELECT query_id, id, rank, round(score, 4) AS score FROM r WHERE rank <= 10""",
)
def k01_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every vector whose id is divisible by 50, against all."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return s.top_k(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 4))


@q("k02_text_search", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'harbour') ORDER BY doc_id LIMIT 100")
def k02_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback without vectors: the first 100 hits, which is the feature."""
    return table(spark, sf_dir, "documents", "doc_id", "text").filter(s.contains_text(F.col("text"), "harbour")).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(100)


_SOURCES = {"ner": 0, "extraction": 1}


@q("w01_keep_best", f"SELECT entity_type, text, entity_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY lower(entity_type), lower(text) ORDER BY confidence DESC NULLS LAST, CASE source WHEN 'ner' THEN 0 WHEN 'extraction' THEN 1 ELSE 2 END, entity_id) AS r FROM {_ENTITY} WHERE entity_type = 'DATE') WHERE r = 1")
def w01_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("source") == "ner", 0).when(F.col("source") == "extraction", 1).otherwise(2)
    rows = entities(spark, sf_dir).filter("entity_type = 'DATE'")
    return l.keep_best(rows, [F.lower("entity_type"), F.lower("text")], [F.desc_nulls_last("confidence"), rank, F.col("entity_id")]).select("entity_type", "text", "entity_id", "confidence")


@q("w02_renumber", f"SELECT entity_id, 'ent_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS new_id FROM (SELECT entity_id, row_number() OVER (PARTITION BY coalesce(document_name, '') ORDER BY page NULLS FIRST, entity_id) AS r FROM {_ENTITY})")
def w02_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir).withColumn("document_name", F.coalesce("document_name", F.lit("")))
    return l.renumber(rows, ["document_name"], [F.asc_nulls_first("page"), F.asc("entity_id")], "ent_").select("entity_id", "new_id")


@q(
    "w05_missing_lines",
    """WITH t AS (SELECT o_orderkey AS k, 9 AS n FROM orders), p AS (SELECT t.k, unnest(range(1, n + 1)) AS p FROM t),
m AS (SELECT p.k, p.p, p.p - row_number() OVER (PARTITION BY p.k ORDER BY p.p) AS island FROM p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = p.k AND l_linenumber = p.p)),
i AS (SELECT k, p, island, (row_number() OVER (PARTITION BY k, island ORDER BY p) - 1) // 3 AS part FROM m)
SELECT k AS order_key, min(p) AS first, max(p) AS last FROM i GROUP BY k, island, part""",
)
def w05_missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing line numbers 1 to 9 of every order, in runs of at most three."""
    totals = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("order_key"), F.lit(9).alias("n"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").toDF("order_key", "page")
    return g.missing_chunks(totals, lines, "order_key", "n", "page", 3)


_PAGE = "(SELECT DISTINCT page_id, document_id, page_number, text FROM bundle_pages)"


@q(
    "w06_context",
    f"""WITH p AS (SELECT page_id, document_id, page_number, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 200) AS h FROM {_PAGE})
SELECT page_id, lag(h) OVER w AS before, lead(h) OVER w AS after, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS earlier, count(*) OVER (w ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number, page_id)""",
)
def w06_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bundle_pages", "page_id", "document_id", "page_number", "text").distinct()
    rows = rows.withColumn("at", F.struct("page_number", "page_id"))
    return g.context(rows, "document_id", "at", "text").select("page_id", "before", "after", "earlier", "later")


@q("w07_numbers", "SELECT document_id, 'DOC' || lpad(row_number() OVER (PARTITION BY coalesce(classification.label, '') ORDER BY generated_at, document_id)::VARCHAR, 7, '0') AS number FROM retrieval_documents")
def w07_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_documents", "document_id", "generated_at", "classification.label").withColumn("label", F.coalesce("label", F.lit("")))
    return g.running_numbers(rows, ["label"], [F.asc("generated_at"), F.asc("document_id")], "DOC", 1, 7).select("document_id", "number")


@q(
    "w08_continuity",
    f"""WITH n AS (SELECT regexp_extract(text, '^([A-Za-z]+)\\s?(\\d+)$', 1) AS prefix, try_cast(regexp_extract(text, '^([A-Za-z]+)\\s?(\\d+)$', 2) AS BIGINT) AS n FROM {_ENTITY} WHERE entity_type = 'BATES_NUMBER'),
c AS (SELECT prefix, n, count(*) AS times FROM n WHERE n IS NOT NULL GROUP BY 1, 2)
SELECT prefix, sum(times)::BIGINT AS items, min(n) AS first, max(n) AS last, count(*) FILTER (times > 1) AS duplicates, max(n) - min(n) + 1 - count(*) AS missing FROM c GROUP BY 1""",
)
def w08_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.continuity(entities(spark, sf_dir).filter("entity_type = 'BATES_NUMBER'"), "text")


@q("j02_near_pairs")
def j02_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one text at most 150 characters apart."""
    spans = x.spans(_texts(spark, sf_dir), "document_id", "text", x.entity_patterns()).withColumn("ordinal", F.xxhash64("kind", "value"))
    return l.near_pairs(spans, "document_id", 150).select("document_id", "a_kind", "a_value", "a_begin", "b_kind", "b_value", "b_begin", "distance")


@q("j03_without_overlap")
def j03_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that overlap no entity in the same text."""
    fields = x.spans(_texts(spark, sf_dir), "document_id", "text", {"reference": x.field_patterns()["reference"], "phone": x.field_patterns()["phone"]})
    found = x.spans(_texts(spark, sf_dir), "document_id", "text", x.entity_patterns())
    return l.without_overlap(fields, found, ["document_id"])


@q(
    "j04_by_priority",
    f"""WITH e AS (SELECT DISTINCT lower(entity_type) AS kind, lower(trim(text)) AS value, source FROM {_ENTITY} WHERE text IS NOT NULL),
a AS (SELECT DISTINCT kind, value FROM e WHERE source = 'ner'), b AS (SELECT DISTINCT kind, value FROM e WHERE source = 'extraction'), c AS (SELECT DISTINCT kind, value FROM e WHERE source IS NULL OR source NOT IN ('ner', 'extraction'))
SELECT kind, value, 0 AS tier FROM a UNION ALL SELECT kind, value, 1 FROM b ANTI JOIN a USING (kind, value) UNION ALL SELECT kind, value, 2 FROM c ANTI JOIN a USING (kind, value) ANTI JOIN b USING (kind, value)""",
)
def j04_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).filter("text is not null").select(F.lower("entity_type").alias("kind"), F.lower(F.trim("text")).alias("value"), "source").distinct()
    tier = lambda c: e.filter(c).select("kind", "value").distinct()
    rest = "source is null or source not in ('ner', 'extraction')"
    return l.by_priority([tier("source = 'ner'"), tier("source = 'extraction'"), tier(rest)], ["kind", "value"])


@q(
    "j05_nearest",
    f"""WITH p AS (SELECT entity_id, job_id, page FROM {_ENTITY} WHERE entity_type = 'MONEY' AND page IS NOT NULL), d AS (SELECT entity_id AS date_id, job_id, page AS dp FROM {_ENTITY} WHERE entity_type = 'DATE' AND page IS NOT NULL),
r AS (SELECT p.job_id, p.entity_id, d.date_id, abs(p.page - d.dp) AS distance, row_number() OVER (PARTITION BY p.job_id, p.entity_id ORDER BY abs(p.page - d.dp), d.date_id) AS r FROM p JOIN d USING (job_id))
SELECT job_id, entity_id, date_id, distance FROM r WHERE r = 1""",
)
def j05_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every amount the date on the nearest page of its job."""
    e = entities(spark, sf_dir).filter("page is not null")
    money, dates = e.filter("entity_type = 'MONEY'"), e.filter("entity_type = 'DATE'").withColumnRenamed("entity_id", "date_id")
    return l.nearest(money, dates, "job_id", "entity_id", "page", "date_id", "page")


@q(
    "j06_as_of",
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, c.click_id, c.click_ts FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.click_ts""",
)
def j06_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the user's latest click before it."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    clicks = rows.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    return l.as_of(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click_ts", ["click_id", "click_ts"]).drop("ts")


_BOX = "(SELECT DISTINCT document_id, span_id, page_number, source_bbox[1] AS x1, source_bbox[2] AS y1, source_bbox[3] AS x2, source_bbox[4] AS y2, confidence FROM translation_spans)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("source_bbox")
    rows = table(spark, sf_dir, "translation_spans", "document_id", "span_id", "page_number", "source_bbox", "confidence")
    return rows.select("document_id", "span_id", "page_number", *(F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), "confidence").distinct()


@q("j07_boxes_meet", f"SELECT a.document_id, a.span_id AS span_a, b.span_id AS span_b FROM {_BOX} a JOIN {_BOX} b ON a.document_id = b.document_id AND a.page_number = b.page_number AND a.span_id < b.span_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
def j07_boxes_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a page whose boxes overlap: boxes meet in the bands of height that both touch."""
    band = F.explode(F.sequence(F.floor(F.col("y1") / 100), F.floor(F.col("y2") / 100))).alias("band")
    rows = _boxes(spark, sf_dir).filter("y1 is not null and y2 >= y1").select("*", band)
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_number") == F.col("b.page_number")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.span_id") < F.col("b.span_id"))
    return a.join(b, on & l.boxes_meet("a", "b")).select("a.document_id", F.col("a.span_id").alias("span_a"), F.col("b.span_id").alias("span_b")).distinct()


@q("u02_pages_without", f"SELECT DISTINCT document_id FROM retrieval_documents EXCEPT SELECT document_id FROM bundle_pages")
def u02_pages_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval_documents", "document_id").distinct().join(table(spark, sf_dir, "bundle_pages", "document_id"), "document_id", "left_anti")


@q(
    "u05_registry_diff",
    """WITH old AS (SELECT lower(trim(job_id)) AS k, min(status) AS s FROM jobs WHERE created_at < TIMESTAMPTZ '2025-09-01 00:00:00+00' GROUP BY 1), new AS (SELECT lower(trim(job_id)) AS k, max(status) AS s FROM jobs WHERE created_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' GROUP BY 1)
SELECT CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'removed' WHEN old.s <> new.s THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM old FULL JOIN new ON old.k = new.k GROUP BY 1""",
)
def u05_registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two states of a registry."""
    rows = table(spark, sf_dir, "jobs", "job_id", "status", "created_at").withColumn("k", F.lower(F.trim("job_id")))
    old = rows.filter("created_at < timestamp '2025-09-01 00:00:00'").groupBy("k").agg(F.min("status").alias("s")).alias("old")
    new = rows.filter("created_at >= timestamp '2025-06-01 00:00:00'").groupBy("k").agg(F.max("status").alias("s")).alias("new")
    change = F.when(F.col("old.k").isNull(), "added").when(F.col("new.k").isNull(), "removed").when(F.col("old.s") != F.col("new.s"), "changed").otherwise("same")
    return old.join(new, F.col("old.k") == F.col("new.k"), "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@q("u06_page_lists", "SELECT job_id, len(range(1, total_pages + 1, 2)) AS odd_pages FROM (SELECT DISTINCT job_id, total_pages FROM jobs WHERE total_pages > 0)")
def u06_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs", "job_id", "total_pages").filter("total_pages > 0").distinct()
    return rows.select("job_id", F.size(F.expr("sequence(1, total_pages, 2)")).cast("long").alias("odd_pages"))


@q(
    "t06_complete",
    f"""WITH p AS (SELECT document_id, count(DISTINCT page_number) AS pages, max(page_number) AS last FROM {_PAGE} GROUP BY 1)
SELECT document_id, pages, pages = last AS complete FROM p""",
)
def t06_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents all of whose pages arrived."""
    rows = table(spark, sf_dir, "bundle_pages", "document_id", "page_number").distinct()
    return rows.groupBy("document_id").agg(F.count("page_number").alias("pages"), F.max("page_number").alias("last")).select("document_id", "pages", (F.col("pages") == F.col("last")).alias("complete"))


@q(
    "t10_sessions",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS start, count(*) AS events, round(sum(value), 3) AS total FROM s GROUP BY user_id, n""",
)
def t10_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "ts", "value").filter("user_id is not null")
    w = F.session_window("ts", "30 minutes")
    return rows.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 3).alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")


@q("o01_cube", "SELECT r_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderpriority)")
def o01_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), table(spark, sf_dir, "region", "r_regionkey", "r_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.cube("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("o02_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def o02_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate <= '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
