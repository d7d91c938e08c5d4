"""Problem 2: near-duplicate records with small edits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from docan.llm.near_duplicates import NearDuplicates
from docan.plans.registry import Registry
from docan.sources.tables import table

registry = Registry()

_FOUND_SQL = """
WITH d AS (SELECT document_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM retrieval_documents WHERE document_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS h FROM d WHERE len(w) >= 3),
n AS (SELECT document_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.document_id AS x, b.document_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.document_id < b.document_id GROUP BY 1, 2)
SELECT x AS document_id_a, y AS document_id_b FROM o JOIN n p ON p.document_id = x JOIN n q ON q.document_id = y WHERE common * 5 >= (p.n + q.n - common) * 3
UNION SELECT a.document_id, b.document_id FROM d a JOIN d b ON a.text = b.text AND a.document_id < b.document_id WHERE len(a.w) > 0"""


def _join(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    """Three words and 0.6, as the project's data ask."""
    return NearDuplicates(table(spark, sf_dir, "retrieval_documents", "document_id", "text"), "document_id", "text", 3, Fraction(3, 5))


@registry.query("p2_found", _FOUND_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join(spark, sf_dir).id_pairs().toDF("document_id_a", "document_id_b")


@registry.query("p2_groups")
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every record."""
    return _join(spark, sf_dir).groups().withColumnRenamed("id", "document_id")
