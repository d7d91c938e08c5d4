"""Document roll-ups, quality measures, chains and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.functions import texts as t
from docan.operators import custody, rollups as r
from docan.operators import extraction as x
from docan.operators.linking import keep_best, near_pairs
from docan.plans import extraction_queries as eq
from docan.plans.linking_queries import _ENTITY, entities
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()
q = registry.query


@q(
    "r23_validation",
    """WITH p AS (SELECT document_id, count(*) AS pages, count(*) FILTER (trim(text) <> '') AS with_text FROM (SELECT DISTINCT page_id, document_id, text FROM bundle_pages) GROUP BY 1),
c AS (SELECT document_id, avg(confidence) AS conf FROM (SELECT DISTINCT span_key, document_id, confidence FROM translation_spans) WHERE confidence > 0 GROUP BY 1),
j AS (SELECT document_id, pages, with_text / pages AS rate, coalesce(conf, 0) AS conf FROM p LEFT JOIN c USING (document_id))
SELECT document_id, pages, round(rate, 9) AS rate, round(conf, 9) AS confidence, CASE WHEN rate >= 1.0 AND conf >= 0.85 THEN 'high_quality' WHEN rate >= 0.80 AND conf >= 0.60 THEN 'acceptable' WHEN rate >= 0.50 OR conf >= 0.40 THEN 'degraded' ELSE 'review_required' END AS quality FROM j""",
)
def r23_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "bundle_pages", "page_id", "document_id", "text").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.trim("text") != "").alias("with_text"))
    conf = table(spark, sf_dir, "translation_spans", "span_key", "document_id", "confidence").distinct().filter("confidence > 0").groupBy("document_id").agg(F.avg("confidence").alias("conf"))
    rate, c = F.col("with_text") / F.col("pages"), F.coalesce("conf", F.lit(0.0))
    return pages.join(conf, "document_id", "left").select("document_id", "pages", F.round(rate, 9).alias("rate"), F.round(c, 9).alias("confidence"), r.quality_class(rate, c).alias("quality"))


@q("r24_entity_summary", f"SELECT document_name, entity_type, count(*) AS entities, count(DISTINCT lower(trim(text))) AS distinct_texts, list_sort(list(DISTINCT page) FILTER (page IS NOT NULL))::VARCHAR AS pages FROM {_ENTITY} GROUP BY 1, 2")
def r24_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.concat(F.lit("["), F.concat_ws(", ", F.transform("pages", lambda p: p.cast("string"))), F.lit("]"))
    return r.entity_summary(entities(spark, sf_dir), "document_name").withColumn("pages", pages)


@q("r31_first_seen", f"SELECT document_name, entity_type, text FROM (SELECT *, row_number() OVER (PARTITION BY document_name, entity_type, lower(trim(text)) ORDER BY page NULLS FIRST, entity_id) AS n FROM {_ENTITY}) WHERE n = 1")
def r31_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.first_seen(entities(spark, sf_dir), "document_name", [F.asc_nulls_first("page"), F.asc("entity_id")]).select("document_name", "entity_type", "text")


_SPAN = "(SELECT DISTINCT span_key, document_id, page_number, source_language, source_text, confidence, quality_score, engine_id, target_language FROM translation_spans)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "translation_spans", "span_key", "document_id", "page_number", "source_language", "source_text", "confidence", "quality_score", "engine_id", "target_language").distinct()


@q(
    "r27_language_shares",
    f"""WITH b AS (SELECT document_id, coalesce(source_language, 'und') AS language, sum(length(source_text)) AS chars, sum(length(source_text) * confidence) AS c FROM {_SPAN} WHERE source_text IS NOT NULL GROUP BY 1, 2)
SELECT document_id, language, chars::BIGINT AS chars, round(CASE WHEN sum(chars) OVER w > 0 THEN chars / sum(chars) OVER w ELSE 0 END, 9) AS share, round(CASE WHEN chars > 0 THEN c / chars ELSE 0 END, 9) AS confidence, language = first_value(language) OVER (w ORDER BY chars DESC, language DESC) AS main FROM b WINDOW w AS (PARTITION BY document_id)""".replace(
        "OVER (w ORDER BY chars DESC, language DESC)", "OVER (PARTITION BY document_id ORDER BY chars DESC, language DESC)"
    ),
)
def r27_language_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).filter("source_text is not null").withColumn("language", F.coalesce("source_language", F.lit("und")))
    shares = r.language_shares(rows, ["document_id"], "language", F.length("source_text"), "confidence")
    main = r.main_language(shares, ["document_id"], "language").withColumnRenamed("language", "top")
    return shares.join(main, "document_id").select("document_id", "language", "chars", F.round("share", 9).alias("share"), F.round("confidence", 9).alias("confidence"), (F.col("language") == F.col("top")).alias("main"))


@q(
    "r33_strata",
    f"SELECT engine_id, target_language, count(quality_score) AS n, round(avg(quality_score), 6) AS mean, min(quality_score) AS low FROM {_SPAN} GROUP BY GROUPING SETS ((), (engine_id), (target_language))",
)
def r33_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality in all, by engine and by language, in one pass."""
    e, l = F.col("engine_id"), F.col("target_language")
    return _spans(spark, sf_dir).groupingSets([[], [e], [l]], e, l).agg(F.count("quality_score").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean"), F.min("quality_score").alias("low"))


@q(
    "r34_class_scores",
    "WITH g AS (" + eq.registry.oracles["f04_types"] + "), t AS (SELECT d.document_id, d.classification.label AS t, g.doc_type AS g FROM retrieval_documents d JOIN g USING (document_id)), l AS (SELECT DISTINCT unnest([t, g]) AS label FROM t), c AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (g = label) AS said, count(*) FILTER (t = label AND g = label) AS hit FROM l, t WHERE label IS NOT NULL GROUP BY 1), s AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s",
)
def r34_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types guessed from text against the stored labels."""
    kind, _ = x.best_type(x.type_scores(F.col("text")))
    rows = table(spark, sf_dir, "retrieval_documents", "classification.label", "text").select(F.col("label").alias("t"), kind.alias("g"))
    return r.class_scores(rows, "t", "g")


_REVIEW = "(SELECT DISTINCT review_id, confidence, status FROM review_items)"


@q(
    "r36_reliability",
    f"SELECT least(floor(greatest(0.0, least(1.0, confidence)) * 10), 9)::INT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_score, round(avg((status = 'approved')::INT), 6) AS share_true FROM {_REVIEW} WHERE confidence IS NOT NULL GROUP BY 1",
)
def r36_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "review_items", "review_id", "confidence", "status").distinct()
    return r.reliability(rows, "confidence", F.col("status") == "approved").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share_true", 6).alias("share_true"))


@q(
    "r36_calibration",
    f"WITH b AS (SELECT least(floor(greatest(0.0, least(1.0, confidence)) * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS c, avg((status = 'approved')::INT) AS a FROM {_REVIEW} WHERE confidence IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b",
)
def r36_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "review_items", "review_id", "confidence", "status").distinct()
    return r.calibration_error(r.reliability(rows, "confidence", F.col("status") == "approved"))


@q(
    "r41_quality",
    f"SELECT document_id, count(quality_score) AS spans, round(avg(quality_score), 9) AS mean, min(quality_score) AS low, count(*) FILTER (quality_score < 0.2) AS rejected, count(*) FILTER (quality_score >= 0.2 AND quality_score < 0.4) AS warned FROM {_SPAN} GROUP BY 1",
)
def r41_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a document's spans; a rejected span is not counted as warned."""
    s = F.col("quality_score")
    return _spans(spark, sf_dir).groupBy("document_id").agg(F.count(s).alias("spans"), F.round(F.avg(s), 9).alias("mean"), F.min(s).alias("low"), F.count_if(s < 0.2).alias("rejected"), F.count_if((s >= 0.2) & (s < 0.4)).alias("warned"))


@q("r46_votes", f"""WITH b AS (SELECT document_id, target_language AS label, count(*) AS pages, avg(confidence) AS mean FROM {_SPAN} WHERE target_language IS NOT NULL GROUP BY 1, 2)
SELECT document_id, label, pages FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pages DESC, round(mean, 9) DESC NULLS LAST, label) AS n FROM b) WHERE n = 1""")
def r46_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).withColumnRenamed("target_language", "label")
    return r.votes(rows, "document_id", "label", "confidence").select("document_id", "label", "pages")


@q("w03_relations")
def w03_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of near entities, each kept once with its greatest confidence."""
    spans = x.spans(eq._texts(spark, sf_dir), "document_id", "text", x.entity_patterns()).withColumn("ordinal", F.xxhash64("kind", "value"))
    pairs = near_pairs(spans, "document_id", 150).withColumn("confidence", F.round((1 - F.col("distance") / 150) * 0.6, 4))
    best = keep_best(pairs, [F.col("document_id"), F.col("a_value"), F.col("b_value"), F.concat_ws("-", "a_kind", "b_kind")], [F.desc("confidence"), F.asc("a_begin"), F.asc("b_begin")])
    return best.select("document_id", "a_kind", "a_value", "b_kind", "b_value", "confidence").filter("confidence >= 0.4")


@q("f17_agreement", "SELECT p_partkey, CASE WHEN lower(trim(p_name)) = lower(trim(p_type)) THEN 1.0 ELSE round(1 - levenshtein(lower(trim(p_name)), lower(trim(p_type))) / greatest(length(trim(p_name)), length(trim(p_type))), 4) END AS score FROM part")
def f17_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select("p_partkey", t.agreement(F.col("p_name"), F.col("p_type")).alias("score"))


@q("f16_error_rates")
def f16_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word error rates of pages against their spans' texts."""
    rows = table(spark, sf_dir, "translation_spans", "span_key", "source_text", "translated_text").distinct()
    a, b = F.col("source_text"), F.col("translated_text")
    return rows.select("span_key", F.round(t.character_error_rate(a, b), 6).alias("cer"), F.round(t.word_error_rate()(a, b), 6).alias("wer"), F.round(t.line_accuracy(a, b), 6).alias("lines"))


@q("f18_normal_forms")
def f18_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_spans", "span_key", "source_text").distinct()
    return rows.select("span_key", t.normal_form("NFC")("source_text").alias("nfc"), t.normal_form("NFKC")("source_text").alias("nfkc"), t.rtl_ratio()("source_text").alias("rtl"))


@q("f25_summaries")
def f25_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most connected sentences of every text."""
    return eq._texts(spark, sf_dir).select("document_id", F.concat_ws(" ", t.summary(5)("text")).alias("summary"))


@q("f29_glossary", "SELECT doc_id, md5(replace(replace(text, 'harbour', 'port'), 'ledger', 'account book')) AS digest FROM documents WHERE text IS NOT NULL")
def f29_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    return rows.select("doc_id", F.md5(t.apply_glossary(F.col("text"), [("harbour", "port"), ("ledger", "account book")]).cast("binary")).alias("digest"))


@q("m02_document_ids", "SELECT document_id, sha256(source_file)[1:16] AS path_id, sha256(coalesce(source_file, '') || '|' || coalesce(schema_version, '') || '|' || coalesce(length(text), 0)::VARCHAR)[1:16] AS resume_id FROM retrieval_documents")
def m02_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_documents", "document_id", "source_file", "schema_version", "text")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat_ws("|", some("source_file"), some("schema_version"), F.coalesce(F.length("text"), F.lit(0)).cast("string"))
    return rows.select("document_id", F.substring(F.sha2("source_file", 256), 1, 16).alias("path_id"), F.substring(F.sha2(whole, 256), 1, 16).alias("resume_id"))


@q(
    "m19_bundles",
    """WITH p AS (SELECT DISTINCT page_id, document_id, page_number, text FROM bundle_pages)
SELECT document_id, count(*) AS pages, sha256(string_agg(coalesce(text, ''), chr(12) ORDER BY page_number, page_id)) AS digest FROM p GROUP BY 1""",
)
def m19_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document in order as one bundle, with its digest."""
    rows = table(spark, sf_dir, "bundle_pages", "page_id", "document_id", "page_number", "text").distinct()
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "page_id", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), ordered.alias("o")).select("document_id", "pages", F.sha2(F.array_join(F.transform("o", lambda p: p["text"]), "\f"), 256).alias("digest"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_events", "event_id", "event_type", "job_id", "payload_json", "created_at").distinct().filter("trim(job_id) <> ''")
    at = F.coalesce(F.try_to_timestamp("created_at"), F.lit("1970-01-01").cast("timestamp"))
    return rows.select(F.lower(F.trim("job_id")).alias("document_id"), "event_type", F.col("created_at").alias("timestamp"), F.col("payload_json").alias("data"), F.struct(at.alias("at"), "event_id").alias("order_key"))


@q("c01_chains")
def c01_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's events as a hash chain."""
    return custody.build(_events(spark, sf_dir))


@q("c02_verified")
def c02_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every job's chain after the third event of some was altered."""
    chain = custody.build(_events(spark, sf_dir))
    altered = (F.col("seq") == 2) & (F.pmod(F.xxhash64("document_id"), F.lit(7)) == 0)
    return custody.verify(chain.withColumn("data", F.when(altered, F.lit('{"altered": true}')).otherwise(F.col("data"))))
