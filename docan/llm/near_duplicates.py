"""Near-duplicate texts by a grouped prefix join over word shingles.

The similarity of two texts is the Jaccard coefficient of their sets of consecutive words. Texts with
equal sets form a class, represented once. Shingles are ordered from rare to frequent; two sets can
only reach the threshold if their prefixes in this order, as long as the threshold asks, share a
shingle. Shingles that occur in one class only come first in the order and can be left out of it.

Classes with identical prefixes and size are one group. Groups that share a prefix shingle are paired,
once past the filters: size, number of shingles that occur elsewhere at all, and, for groups of one
class, the bitmap filter (the set bits of the difference of two parity bitmaps are a lower bound of the
sets' difference). Surviving group pairs are expanded to their classes, filtered again, and verified
by intersecting the sets. No filter ever drops a pair that reaches the threshold.

Defined results
* null text, or a text without words: in no class and no pair;
* texts of fewer words than a shingle: alike only when the texts are identical;
* null id: the row is skipped, it cannot be named;
* repeated rows: rows of one id with one text are one record; an id with several texts is in the class
  of each, and never paired with itself;
* ties: none matter, every pair that reaches the threshold is returned;
* very long texts: whole sets are compared; empty table: empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docan.llm.components import components
from docan.llm.words import words
from docan.session import checkpoint

SHINGLE_WORDS = 5
THRESHOLD = Fraction(4, 5)
BITS = 1024

_U = np.uint64


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    for k in range(size):
        total = _scramble(total + hashes[k : k + n] + _U(k + 1))
    return np.unique(total)


def sets(records: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(id, n, key, bits, shingles): the shingle set of each record, its fingerprint and parity bitmap."""
    rows = records.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter("id is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        lookup = _WordHash()
        kind = pa.list_(pa.int64())
        for batch in batches:
            ids, n, key, bits, found = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                run_of = words(text)
                if not run_of:
                    continue
                hashes = np.fromiter(map(lookup.__getitem__, run_of), dtype=_U, count=len(run_of))
                own = shingle_set(hashes, size)
                ids.append(doc)
                n.append(len(own))
                key.append(xxh3_64_intdigest(own.tobytes() if len(own) else b"t" + text.encode("utf-8", "surrogatepass")) - (1 << 63))
                flips = np.bincount((own >> _U(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1
                bits.append(np.packbits(flips).view(np.int64))
                found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(n, type=pa.int32()), pa.array(key, type=pa.int64()), pa.array(bits, type=kind), pa.array(found, type=kind)], names=["id", "n", "key", "bits", "shingles"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n int, key long, bits array<long>, shingles array<long>")


def _needed(n1: Column, n2: Column, t: Fraction) -> Column:
    """Least overlap with which sets of these sizes reach the threshold."""
    return F.expr("0") + F.ceil((n1 + n2) * F.lit(t.numerator) / F.lit(t.numerator + t.denominator) - F.lit(1e-9))


def _bit_columns() -> list[Column]:
    return [F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)]


def _near_bits(a: str, b: str) -> Column:
    total = F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0")))
    for i in range(1, BITS // 64):
        total = total + F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}")))
    return total


def class_pairs(classes: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(n_a, key_a, n_b, key_b, overlap) of distinct shingle sets that reach the threshold, a before b.

    ``classes`` has one row (n, key, bits, shingles) for each distinct set and must be cheap to read.
    """
    t = threshold
    each = classes.filter("n > 0").select("n", "key", F.explode("shingles").alias("h"))
    frequent = each.groupBy("h").count().filter("count > 1").select("h", F.col("count").alias("df"))
    # n - ceil(t n) + 1 shingles make the prefix; those of one class only come first and cannot match
    prefix_size = F.expr(f"n - cast(ceil(n * {t.numerator} / {t.denominator} - 1e-9) as int) + 1")
    shared = each.join(frequent, "h").groupBy("n", "key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    ns = F.size("s")
    least = F.expr(f"ceil(n * {t.numerator} / {t.denominator} - 1e-9)")  # a partner shares at least t n of the set
    heads = shared.filter(ns >= least).select("n", "key", ns.alias("ns"), F.slice(F.col("s")["h"], F.lit(1), F.greatest(prefix_size - (F.col("n") - ns), F.lit(0))).alias("prefix")).filter("size(prefix) > 0")
    heads = heads.withColumn("gid", F.xxhash64("n", "prefix"))
    members = checkpoint(heads.join(classes.select("n", "key", *_bit_columns()), ["n", "key"]))
    bits = [f"b{i}" for i in range(BITS // 64)]
    groups = members.groupBy("gid", "n").agg(
        F.count(F.lit(1)).alias("classes"), F.max("ns").alias("ns"), F.first("prefix").alias("prefix"), *(F.max(b).alias(b) for b in bits)
    )
    postings = groups.select("gid", "n", "ns", "classes", *bits, F.explode("prefix").alias("h"))
    a, b = postings.alias("a"), postings.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    need = _needed(na, nb, t)
    alike = (F.least(na, nb) * t.denominator >= F.greatest(na, nb) * t.numerator) & (F.least("a.ns", "b.ns") >= need)
    single = (F.col("a.classes") == 1) & (F.col("b.classes") == 1)
    close = ~single | (_near_bits("a", "b") <= na + nb - 2 * need)
    pairs = (
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.struct("a.n", "a.gid") < F.struct("b.n", "b.gid")) & alike & close)
        .select(na.alias("n_a"), F.col("a.gid").alias("gid_a"), nb.alias("n_b"), F.col("b.gid").alias("gid_b"))
        .distinct()
    )
    inside = groups.filter("classes > 1").select(F.col("n").alias("n_a"), F.col("gid").alias("gid_a"), F.col("n").alias("n_b"), F.col("gid").alias("gid_b"))
    left = members.select(F.col("n").alias("n_a"), F.col("gid").alias("gid_a"), F.col("key").alias("key_a"), *(F.col(x).alias(f"l{x}") for x in bits))
    right = members.select(F.col("n").alias("n_b"), F.col("gid").alias("gid_b"), F.col("key").alias("key_b"), *(F.col(x).alias(f"r{x}") for x in bits))
    differ = sum((F.bit_count(F.col(f"l{x}").bitwiseXOR(F.col(f"r{x}"))) for x in bits), F.lit(0))
    expanded = (
        pairs.unionByName(inside)
        .join(left, ["n_a", "gid_a"])
        .join(right, ["n_b", "gid_b"])
        .filter((F.struct("n_a", "gid_a") < F.struct("n_b", "gid_b")) | (F.col("key_a") < F.col("key_b")))
        .filter(differ <= F.col("n_a") + F.col("n_b") - 2 * _needed(F.col("n_a"), F.col("n_b"), t))
        .select("n_a", "key_a", "n_b", "key_b")
    )
    whole = classes.select("n", "key", "shingles")
    overlap = F.size(F.array_intersect("s_a", "s_b"))
    return (
        expanded.join(whole.toDF("n_a", "key_a", "s_a"), ["n_a", "key_a"])
        .join(whole.toDF("n_b", "key_b", "s_b"), ["n_b", "key_b"])
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") * (t.numerator + t.denominator) >= (F.col("n_a") + F.col("n_b")) * t.numerator)
        .select("n_a", "key_a", "n_b", "key_b", "overlap")
    )


class NearDuplicates:
    """Classes, members and pairs of classes of one table."""

    def __init__(self, records: DataFrame, id_column: str, text_column: str, shingle_words: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> None:
        every = checkpoint(sets(records, id_column, text_column, shingle_words))
        self.members = every.select("id", "n", "key").distinct()
        heads = every.groupBy("n", "key").agg(F.min("id").alias("id"))
        # one row per class: the set comes with its first record, not through the aggregation
        self.classes = every.join(heads, ["n", "key", "id"], "left_semi").dropDuplicates(["n", "key"])
        self.classes = checkpoint(self.classes.select("n", "key", F.col("id").alias("head"), "bits", "shingles"))
        self.pairs = checkpoint(class_pairs(self.classes, threshold))

    def id_pairs(self) -> DataFrame:
        """(id_a, id_b), a < b, of all records in one class or in two paired ones."""
        m = self.members
        inside = m.alias("x").join(m.alias("y"), (F.col("x.n") == F.col("y.n")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
        across = (
            self.pairs.join(m.toDF("p", "n_a", "key_a"), ["n_a", "key_a"]).join(m.toDF("q", "n_b", "key_b"), ["n_b", "key_b"]).filter("p <> q").select("p", "q")
        )
        return inside.unionByName(across).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): one row per record and class.

        ``class_id`` is the first record with the same set, ``group_id`` that of the connected classes,
        ``links`` the number of other classes that reach the threshold.
        """
        named = self.classes.select("n", "key", "head")
        ends = self.pairs.join(named.toDF("n_a", "key_a", "u"), ["n_a", "key_a"]).join(named.toDF("n_b", "key_b", "v"), ["n_b", "key_b"]).select("u", "v")
        ends = checkpoint(ends)
        links = ends.select("u").unionByName(ends.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("links"))
        heads = (
            named.join(components(ends).toDF("head", "group_id"), "head", "left")
            .join(links.withColumnRenamed("u", "head"), "head", "left")
            .select("n", "key", F.col("head").alias("class_id"), F.coalesce("group_id", "head").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )
        return self.members.join(heads, ["n", "key"]).select("id", "class_id", "group_id", "links")
