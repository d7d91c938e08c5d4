"""Problem 7: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.key_filter import distinct_by
from docan.llm.lookalikes import consistent
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()

_UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}]"
_VARIANT = r"[\x{00A0}\x{00AA}\x{00B2}\x{00B3}\x{00B9}\x{00BA}\x{2000}-\x{200A}\x{2010}\x{2011}\x{202F}\x{205F}\x{2070}-\x{207B}\x{2080}-\x{208B}\x{2100}-\x{214F}\x{2160}-\x{217F}\x{2460}-\x{24FF}\x{3000}\x{FB00}-\x{FB06}\x{FE63}\x{FF0D}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
_MIXED = r"\p{Latin}[\p{M}\p{N}]*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}][\p{M}\p{N}]*\p{Latin}"
# the marks of compatibility are those that occur in text; the operator derives all from the Unicode tables
_FOUND_SQL = f"""
WITH t AS (SELECT 'retrieval_documents' AS record_table, document_id AS record_key, text AS t FROM retrieval_documents UNION ALL SELECT 'translation_spans', span_key, source_text FROM translation_spans)
SELECT DISTINCT record_table, record_key FROM t WHERE regexp_matches(t, '{_UNSEEN}') OR regexp_matches(t, '{_VARIANT}') OR nfc_normalize(t) <> t OR regexp_matches(regexp_replace(t, '{_UNSEEN}', '', 'g'), '{_MIXED}')"""

SOURCES = (("retrieval_documents", "document_id", "text"), ("translation_spans", "span_key", "source_text"))


def _forms(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    parts = []
    for name, key, text in SOURCES:
        rows = table(spark, sf_dir, name, key, text)
        done = consistent(rows, [key], text, with_text)
        parts.append(done.select(F.lit(name).alias("record_table"), F.col(key).alias("record_key"), *done.columns[1:]))
    return parts[0].unionByName(parts[1])


@registry.query("p7_found", _FOUND_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.expr("variants + accents_apart + invisible + mixed_words > 0")
    return _forms(spark, sf_dir, False).filter(hit).select("record_table", "record_key").distinct()


@registry.query("p7_texts")
def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return distinct_by(_forms(spark, sf_dir, True), "record_table", "record_key")
