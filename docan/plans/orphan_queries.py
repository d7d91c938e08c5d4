"""Problem 4: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.operators.orphans import Reference, cascade, report
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()

JOB_REFERENCES = (
    Reference("indexed_entities", "entity_id", "job_id", "indexed_at", "jobs", "job_id", "loaded_at"),
    Reference("review_items", "review_id", "job_id", "created_at", "jobs", "job_id", "loaded_at"),
    Reference("job_events", "event_id", "job_id", "created_at", "jobs", "job_id", "loaded_at"),
)
DOCUMENT_REFERENCES = (
    Reference("bundle_pages", "page_id", "document_id", None, "retrieval_documents", "document_id"),
    Reference("translation_spans", "span_key", "document_id", None, "retrieval_documents", "document_id"),
)

SALES_REFERENCES = (
    Reference("nation", "n_nationkey", "n_regionkey", None, "region", "r_regionkey"),
    Reference("customer", "c_custkey", "c_nationkey", None, "nation", "n_nationkey"),
    Reference("customer", "c_custkey", "c_custkey", "reviewed", "account", "c_custkey"),
    Reference("orders", "o_orderkey", "o_custkey", None, "customer", "c_custkey"),
    Reference("lineitem", "line", "l_orderkey", None, "orders", "o_orderkey"),
)
#: Accounts closed up to here are gone.
REVIEWED = "2024-01-20 00:00:00"

_JOB_SQL = """
WITH key AS (
  SELECT lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS k, min(loaded_at) AS arrived
  FROM jobs GROUP BY 1
), purge AS (
  SELECT lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS k, min(purged_at) AS purged
  FROM job_purges GROUP BY 1
), child AS (
  SELECT DISTINCT 'indexed_entities' AS ref_table, entity_id AS ref_id, lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS k, indexed_at AS t FROM indexed_entities
  UNION
  SELECT DISTINCT 'review_items', review_id, lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')), CAST(created_at AS TIMESTAMPTZ) FROM review_items
  UNION
  SELECT DISTINCT 'job_events', event_id, lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')), CAST(created_at AS TIMESTAMPTZ) FROM job_events
), lost AS (
  SELECT c.ref_table, c.ref_id, c.t,
         CASE WHEN purge.purged <= c.t THEN 'deleted' WHEN key.k IS NULL THEN 'missing' ELSE 'later' END AS cause
  FROM child c LEFT JOIN key ON key.k = c.k LEFT JOIN purge ON purge.k = c.k
  WHERE c.k <> '' AND (key.k IS NULL OR key.arrived > c.t OR purge.purged <= c.t)
)"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "jobs": table(spark, sf_dir, "jobs", "job_id", "loaded_at"),
        "indexed_entities": table(spark, sf_dir, "indexed_entities", "entity_id", "job_id", "indexed_at"),
        "review_items": table(spark, sf_dir, "review_items", "review_id", "job_id", "created_at"),
        "job_events": table(spark, sf_dir, "job_events", "event_id", "job_id", "created_at"),
    }
    purges = {"jobs": table(spark, sf_dir, "job_purges", "job_id", "purged_at")}
    return cascade(tables, JOB_REFERENCES, purges)


@registry.query("p4_found", _JOB_SQL + "\nSELECT DISTINCT ref_table, ref_id FROM lost")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id").distinct()


@registry.query(
    "p4_report",
    _JOB_SQL
    + """
SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, 'direct' AS kind, cause, count(*) AS orphans
FROM (SELECT DISTINCT * FROM lost) GROUP BY 1, 2, 3, 4""",
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_orphans(spark, sf_dir))


@registry.query(
    "p4_cascade",
    """
WITH page AS (
  SELECT DISTINCT 'bundle_pages' AS ref_table, p.page_id AS ref_id FROM bundle_pages p
  WHERE trim(p.document_id) <> '' AND NOT EXISTS (SELECT 1 FROM retrieval_documents d WHERE lower(trim(d.document_id)) = lower(trim(p.document_id)))
), span AS (
  SELECT DISTINCT 'translation_spans' AS ref_table, s.span_key AS ref_id FROM translation_spans s
  WHERE trim(s.document_id) <> '' AND NOT EXISTS (SELECT 1 FROM retrieval_documents d WHERE lower(trim(d.document_id)) = lower(trim(s.document_id)))
), checked AS (SELECT * FROM page UNION ALL SELECT * FROM span)
SELECT t.ref_table, count(c.ref_id) AS orphans
FROM (VALUES ('bundle_pages'), ('translation_spans')) t(ref_table) LEFT JOIN checked c USING (ref_table) GROUP BY 1""",
)
def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table of the document graph, zero where none."""
    tables = {
        "retrieval_documents": table(spark, sf_dir, "retrieval_documents", "document_id"),
        "bundle_pages": table(spark, sf_dir, "bundle_pages", "page_id", "document_id"),
        "translation_spans": table(spark, sf_dir, "translation_spans", "span_key", "document_id"),
    }
    lost = cascade(tables, DOCUMENT_REFERENCES).select("ref_table", "ref_id").distinct()
    names = spark.createDataFrame([(r.table,) for r in DOCUMENT_REFERENCES], "ref_table string")
    return names.join(lost, "ref_table", "left").groupBy("ref_table").agg(F.count("ref_id").alias("orphans"))


@registry.query(
    "p4_inherited",
    f"""
WITH RECURSIVE link AS (
  SELECT 'nation' AS t, n_nationkey::VARCHAR AS id, 'region' AS p, n_regionkey::VARCHAR AS k FROM nation
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'account', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'customer', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT 'lineitem', l_orderkey || '-' || l_linenumber, 'orders', l_orderkey::VARCHAR FROM lineitem
), present AS (
  SELECT 'region' AS p, r_regionkey::VARCHAR AS k FROM region
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation
  UNION ALL SELECT 'account', c_custkey::VARCHAR FROM customer WHERE NOT EXISTS (
    SELECT 1 FROM events WHERE event_type = 'error' AND user_id = c_custkey AND ts <= TIMESTAMP '{REVIEWED}')
  UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders
), direct AS (
  SELECT DISTINCT t, id FROM link WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present WHERE present.p = link.p AND present.k = link.k)
), lost AS (
  SELECT t, id FROM direct
  UNION
  SELECT link.t, link.id FROM lost JOIN link ON link.p = lost.t AND link.k = lost.id
)
SELECT t AS ref_table, id AS ref_id, CASE WHEN EXISTS (SELECT 1 FROM direct WHERE direct.t = lost.t AND direct.id = lost.id) THEN 'direct' ELSE 'inherited' END AS kind
FROM lost""",
)
def p4_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose account was closed (an event of type error) by the day of review, with the orders and lines below them."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumn("reviewed", F.lit(REVIEWED).cast("timestamp"))
    tables = {
        "region": table(spark, sf_dir, "region", "r_regionkey"),
        "nation": table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"),
        "customer": customer,
        "account": customer.select("c_custkey"),
        "orders": table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"),
        "lineitem": table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line")),
    }
    closed = table(spark, sf_dir, "events", "user_id", "event_type", "ts").filter("event_type = 'error'").select("user_id", "ts")
    return cascade(tables, SALES_REFERENCES, {"account": closed}, "user_id", "ts").select("ref_table", "ref_id", "kind").distinct()
