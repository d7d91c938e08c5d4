"""Values, types, scripts and chunks from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.functions.patterns import DOCUMENT_TYPES, MEMO_HEADS, PRIVILEGE
from docan.operators import extraction as x
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()
q = registry.query


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval_documents", "document_id", "text")


def _values_sql(patterns: dict[str, str]) -> str:
    quote = lambda p: p.replace("'", "''")
    return " UNION ALL ".join(f"SELECT document_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{quote(p)}', 1)) AS value FROM retrieval_documents" for k, p in patterns.items())


# DuckDB's \\b knows ASCII letters only; the word boundary of the JVM is written out
_ENTITY_SQL = {k: p.replace(r"(?i)\b(", r"(?i)(?:^|[^\p{L}\p{N}_])(") for k, p in x.entity_patterns().items()}


@q("f01_entities", f"SELECT document_id, kind, value, count(*) AS n FROM ({_values_sql(_ENTITY_SQL)}) GROUP BY 1, 2, 3")
def f01_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.values(_texts(spark, sf_dir), "document_id", "text", x.entity_patterns()).groupBy("document_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@q("f01_spans")
def f01_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their positions in code points."""
    return x.spans(_texts(spark, sf_dir), "document_id", "text", x.entity_patterns())


@q("f02_fields", f"SELECT document_id, kind, value, count(*) AS n FROM ({_values_sql(x.field_patterns())}) GROUP BY 1, 2, 3")
def f02_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.values(_texts(spark, sf_dir), "document_id", "text", x.field_patterns()).groupBy("document_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


_MON = "CASE lower({}[1:3]) " + " ".join(f"WHEN '{m}' THEN '{i + 1:02}'" for i, m in enumerate(x.MONTHS)) + " END"


@q(
    "f03_dates",
    f"""WITH t AS (SELECT DISTINCT trim(text) AS v FROM indexed_entities WHERE entity_type = 'DATE' AND text IS NOT NULL)
SELECT v AS value, CASE
 WHEN regexp_matches(v, '^(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})$') THEN regexp_extract(v, '^(\\d{{4}})', 1) || '-' || lpad(regexp_extract(v, '^\\d{{4}}[-/](\\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(v, '(\\d{{1,2}})$', 1), 2, '0')
 WHEN regexp_matches(v, '^(\\d{{1,2}})[-/](\\d{{1,2}})[-/](\\d{{4}})$') THEN regexp_extract(v, '(\\d{{4}})$', 1) || '-' || lpad(regexp_extract(v, '^(\\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(v, '^\\d{{1,2}}[-/](\\d{{1,2}})', 1), 2, '0')
 WHEN regexp_matches(v, '^(\\d{{1,2}})\\s+([A-Za-z]+)\\.?\\s+(\\d{{4}})$') AND {_MON.format("regexp_extract(v, '([A-Za-z]+)', 1)")} IS NOT NULL THEN regexp_extract(v, '(\\d{{4}})$', 1) || '-' || {_MON.format("regexp_extract(v, '([A-Za-z]+)', 1)")} || '-' || lpad(regexp_extract(v, '^(\\d{{1,2}})', 1), 2, '0')
 WHEN regexp_matches(v, '^([A-Za-z]+)\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})$') AND {_MON.format("regexp_extract(v, '([A-Za-z]+)', 1)")} IS NOT NULL THEN regexp_extract(v, '(\\d{{4}})$', 1) || '-' || {_MON.format("regexp_extract(v, '([A-Za-z]+)', 1)")} || '-' || lpad(regexp_extract(v, '\\s(\\d{{1,2}}),?\\s', 1), 2, '0')
 ELSE v END AS iso FROM t""",
)
def f03_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "indexed_entities", "entity_type", "text").filter("entity_type = 'DATE' and text is not null").select(F.trim("text").alias("value")).distinct()
    return v.withColumn("iso", x.normalise_date(F.col("value")))


def _score_sql(kind: str) -> str:
    hit = lambda ps: " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in ps)
    score = f"({hit(DOCUMENT_TYPES[kind])}) / {len(DOCUMENT_TYPES[kind])}"
    return f"CASE WHEN {hit(MEMO_HEADS)} >= 2 THEN {score} ELSE 0 END" if kind == "memo" else score


_KINDS = list(DOCUMENT_TYPES)


@q(
    "f04_types",
    "WITH s AS (SELECT document_id, " + ", ".join(f"coalesce({_score_sql(k)}, 0) AS {k}_" for k in _KINDS) + " FROM retrieval_documents), g AS (SELECT *, greatest(" + ", ".join(f"{k}_" for k in _KINDS) + ") AS top FROM s) SELECT document_id, CASE "
    + " ".join(f"WHEN top > 0 AND {k}_ = top THEN '{k}'" for k in _KINDS) + " ELSE 'other' END AS doc_type, round(top, 4) AS confidence FROM g",
)
def f04_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, top = x.best_type(x.type_scores(F.col("text")))
    return _texts(spark, sf_dir).select("document_id", kind.alias("doc_type"), F.round(top, 4).alias("confidence"))


@q(
    "f34_failures",
    """SELECT CASE WHEN regexp_matches(lower(error_message), 'no text extracted|ocr.*empty|text extraction.*failed|blank.*page|insufficient.*text') THEN 'ocr_text'
 WHEN regexp_matches(lower(error_message), 'out of memory|cuda.*error|gpu.*error|system.*error|permission denied') THEN 'critical'
 WHEN regexp_matches(lower(error_message), 'extract.*failed|pdf.*corrupt|cannot.*render|invalid.*pdf|decrypt.*failed') THEN 'extract_failed' ELSE 'unknown' END AS family, count(*) AS jobs
FROM jobs WHERE error_message IS NOT NULL GROUP BY 1""",
)
def failure_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs", "error_message").filter("error_message is not null")
    return rows.groupBy(x.failure_family(F.col("error_message")).alias("family")).agg(F.count(F.lit(1)).alias("jobs"))


@q(
    "f11_privilege",
    "SELECT document_id, list_sort([k FOR k IN [" + ", ".join(f"'{p}'" for p in PRIVILEGE) + "] IF contains(lower(text), k)])::VARCHAR AS signs FROM retrieval_documents WHERE " + " OR ".join(f"contains(lower(text), '{p}')" for p in PRIVILEGE),
)
def f11_privilege(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    signs = F.array_sort(F.filter(F.array(*map(F.lit, PRIVILEGE)), lambda k: F.contains(low, k)))
    found = _texts(spark, sf_dir).withColumn("s", signs).filter(F.size("s") > 0)
    return found.select("document_id", F.concat(F.lit("["), F.concat_ws(", ", "s"), F.lit("]")).alias("signs"))


@q(
    "f12_key_values",
    """WITH l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS t FROM retrieval_documents)
SELECT document_id, trim(t[1:instr(t, ':') - 1]) AS name, trim(t[instr(t, ':') + 1:]) AS value, count(*) AS n FROM l
WHERE instr(t, ':') > 1 AND length(trim(t[1:instr(t, ':') - 1])) BETWEEN 1 AND 79 AND length(trim(t[instr(t, ':') + 1:])) > 0 GROUP BY 1, 2, 3""",
)
def f12_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.key_values(_texts(spark, sf_dir), "document_id", "text").groupBy("document_id", "name", "value").agg(F.count(F.lit(1)).alias("n"))


_SCRIPT_SQL = {"latin": "A-Za-zÀ-ɏ", "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ӿ", "cjk": "一-鿿぀-ヿ가-힣"}


@q(
    "f19_scripts",
    "SELECT doc_id, " + ", ".join(f"length(regexp_replace(coalesce(text, ''), '[^{c}]', '', 'g')) AS {k}" for k, c in _SCRIPT_SQL.items()) + " FROM documents",
)
def f19_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = x.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(counts[k].cast("long").alias(k) for k in _SCRIPT_SQL))


@q("f23_chunks")
def f23_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of whole texts."""
    return x.chunks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@q(
    "f24_sentences",
    "SELECT document_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM retrieval_documents WHERE text IS NOT NULL",
)
def f24_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return _texts(spark, sf_dir).filter("text is not null").select("document_id", F.size(parts).cast("long").alias("sentences"))
