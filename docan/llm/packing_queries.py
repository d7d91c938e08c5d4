"""Problem 8: filling fixed-capacity containers with texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docan.llm.packing import fill, pack, token_counts
from docan.plans.registry import Registry
from docan.session import checkpoint
from docan.sources.tables import table

registry = Registry()

#: Rank file of the public byte-level BPE and its word pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """One plan per model with its limit as only capacity, and the plan ``joint`` with all of them."""
    limits = {r["model_id"]: [r["max_tokens"]] for r in table(spark, sf_dir, "model_limits").collect()}
    plans = {**limits, "joint": sorted({c for v in limits.values() for c in v})}
    counts = checkpoint(token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer, pattern))
    return pack(counts, plans)


@registry.query("p8_packed")
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text, or of every piece of a text larger than the capacity, in every plan."""
    return _packed(spark, sf_dir).select("plan", "bin_id", F.col("capacity").alias("max_tokens"), F.col("id").alias("doc_id"), "piece", "first_token", F.col("size").alias("n_tokens"))


@registry.query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_packed(spark, sf_dir))
