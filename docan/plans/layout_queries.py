"""Layout, labels and taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.operators import labels, layout
from docan.plans.linking_queries import _BOX
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()
q = registry.query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_spans", "document_id", "page_number", "span_id", "source_bbox").distinct()
    return rows.select("document_id", "page_number", "span_id", layout.flat_box(F.col("source_bbox")).alias("box")).filter("box is not null")


@q(
    "w09_line_spacing",
    f"""WITH b AS (SELECT DISTINCT document_id, page_number, span_id, x1, y1, x2, y2 FROM {_BOX}), g AS (SELECT *, y1 - lag(y2) OVER (PARTITION BY document_id, page_number ORDER BY y1, x1) AS gap FROM b)
SELECT document_id, page_number, count(*) AS lines, round(CASE WHEN count(gap) FILTER (gap > 0) > 1 THEN stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0) ELSE 0 END, 6) AS spacing_cv,
  round(CASE WHEN count(y2 - y1) > 1 AND avg(y2 - y1) <> 0 THEN stddev_pop(y2 - y1) / avg(y2 - y1) ELSE 0 END, 6) AS height_cv FROM g GROUP BY 1, 2""",
)
def w09_line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.spacing(_lines(spark, sf_dir), ["document_id", "page_number"], "box")
    return s.select("document_id", "page_number", "lines", F.round("spacing_cv", 6).alias("spacing_cv"), F.round("height_cv", 6).alias("height_cv"))


@q(
    "m12_directions",
    f"""WITH b AS (SELECT document_id, page_number, avg((CASE WHEN x2 - x1 > 0 THEN (y2 - y1) / (x2 - x1) >= 0.1 ELSE false END)::INT) AS s FROM (SELECT DISTINCT document_id, page_number, span_id, x1, y1, x2, y2 FROM {_BOX}) GROUP BY 1, 2)
SELECT CASE WHEN s >= 0.6 THEN 'vertical' WHEN s >= 0.2 THEN 'mixed' ELSE 'horizontal' END AS direction, count(*) AS pages FROM b GROUP BY 1""",
)
def m12_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by direction, with an aspect low enough to tell these lines apart."""
    rows = _lines(spark, sf_dir).withColumn("box", F.col("box"))
    share = F.avg(layout.vertical("box", 0.1).cast("double"))
    by = rows.groupBy("document_id", "page_number").agg(F.when(share >= 0.6, "vertical").when(share >= 0.2, "mixed").otherwise("horizontal").alias("direction"))
    return by.groupBy("direction").agg(F.count(F.lit(1)).alias("pages"))


@q("w13_reading_order")
def w13_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and places of the lines of every page, read from the right."""
    return layout.vertical_order(_lines(spark, sf_dir), ["document_id", "page_number"], "span_id", "box", 612.0)


TAXONOMY = {"shipping": ["harbour", "cargo", "freight", "barge"], "court": ["counsel", "testimony", "docket", "ruling", "hearing"], "money": ["invoice", "premium", "payment", "mortgage"]}


@q(
    "f08_taxonomy",
    " UNION ALL ".join(
        f"SELECT document_id, '{k}' AS label, round(({' + '.join(f"contains(lower(text), '{w}')::INT" for w in v)}) / {len(v)}, 6) AS confidence FROM retrieval_documents WHERE ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in v)}) / {len(v)} >= 0.3" for k, v in TAXONOMY.items()
    ),
)
def f08_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_documents", "document_id", "text")
    return labels.taxonomy(rows, "document_id", "text", TAXONOMY).select("document_id", "label", F.round("confidence", 6).alias("confidence"))


@q(
    "r35_set_scores",
    """WITH t AS (SELECT d.document_id, coalesce(d.metadata.languages, []) AS have, coalesce(s.want, []) AS want FROM retrieval_documents d LEFT JOIN (SELECT document_id, list(DISTINCT source_language) AS want FROM translation_spans WHERE source_language IS NOT NULL GROUP BY 1) s USING (document_id)),
n AS (SELECT document_id, len(list_intersect(list_distinct(have), want)) AS b, len(list_distinct(have)) AS h, len(want) AS w FROM t)
SELECT document_id, round(CASE WHEN h = 0 AND w = 0 THEN 1 WHEN h > 0 THEN b / h ELSE 0 END, 6) AS precision, round(CASE WHEN h = 0 AND w = 0 THEN 1 WHEN w > 0 THEN b / w ELSE 0 END, 6) AS recall FROM n""",
)
def r35_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stored with a document against those of its spans."""
    none = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "retrieval_documents", "document_id", "metadata.languages")
    want = table(spark, sf_dir, "translation_spans", "document_id", "source_language").filter("source_language is not null").groupBy("document_id").agg(F.collect_set("source_language").alias("want"))
    p, r, _ = labels.set_scores(F.coalesce("languages", none), F.coalesce("want", none))
    return docs.join(want, "document_id", "left").select("document_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@q("t11_cache", "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS held FROM events WHERE user_id IS NOT NULL) WHERE held <= 500")
def t11_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 500 per user keeps when the oldest use goes first."""
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "value").filter("user_id is not null")
    return labels.kept_by_recency(rows, "user_id", "ts", "value", 500, "event_id").select("user_id", "event_id")
