"""Orphan references: rows whose key points to a record that is missing, deleted or arrived later.

``direct_orphans`` decides one foreign key against its parent; ``cascade`` walks a graph of foreign
keys to a fixpoint, so that children of orphaned rows come out as inherited orphans. In both, the rows
of a frequent key are dealt out to pieces before the join, and the parent's row is copied to each piece.

Defined results
* null or blank reference: refers to nothing, never an orphan;
* key spelling: compared trimmed (all white space) and lower-cased on all sides;
* repeated rows: one result row per id; a row with null id keeps its null id;
* null time of the child: existence is checked, the time rules cannot apply;
* parent rows with null arrival: ignored beside dated rows of the key; a key with none dated was there from the start;
* purge with null time: ignored;
* empty parent table: every non-blank reference is an orphan; empty child table: empty result;
* extra columns, whatever their names, are ignored: only the named columns are read;
* several parent rows of one key: children of the key are inherited orphans as soon as one of these rows is an orphan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of one key that stay together in a join; a key with more is dealt out. At most rows / PIECE_ROWS keys are, and TOP.
PIECE_ROWS = 20_000
#: Most keys dealt out, and keys tracked to find them.
TOP, TRACKED = 1_000, 32_768


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``table.ref_column`` refers to ``parent`` (its ``id_column``)."""

    table: str
    id_column: str
    ref_column: str
    time_column: str | None
    parent: str
    parent_key: str
    parent_time: str | None = None


def canonical_key(key: Column, dtype: str = "string") -> Column:
    """Trimmed, lower-cased key; null when nothing is left. Whole numbers are only written out."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return key.cast("string")
    trimmed = F.lower(F.regexp_replace(key.cast("string"), r"^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def instant(column: Column, dtype: str) -> Column:
    """A timestamp from a timestamp column or an ISO-8601 string with offset; null if unreadable."""
    return column if dtype.startswith("timestamp") else F.try_to_timestamp(column)


def _parent_times(parent: DataFrame, key: str, arrived: str | None) -> DataFrame:
    """Canonical key and its earliest arrival."""
    when = instant(F.col(arrived), dict(parent.dtypes)[arrived]) if arrived else F.lit(None).cast("timestamp")
    start = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return (
        parent.select(canonical_key(F.col(key), dict(parent.dtypes)[key]).alias("key"), when.alias("arrived"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.coalesce(F.min("arrived"), start).alias("arrived"))
    )


def _purge_times(purges: DataFrame, key: str, purged: str) -> DataFrame:
    return (
        purges.select(canonical_key(F.col(key), dict(purges.dtypes)[key]).alias("key"), instant(F.col(purged), dict(purges.dtypes)[purged]).alias("purged"))
        .filter(F.col("key").isNotNull() & F.col("purged").isNotNull())
        .groupBy("key")
        .agg(F.min("purged").alias("purged"))
    )


def key_states(parent: DataFrame, parent_key: str, arrived: str | None, purges: DataFrame | None = None, purge_key: str = "job_id", purged: str = "purged_at") -> DataFrame:
    """One row per parent key: (key, arrived, purged). Keys known only from purges have null ``arrived``."""
    times = _parent_times(parent, parent_key, arrived)
    if purges is None:
        return times.withColumn("purged", F.lit(None).cast("timestamp"))
    return times.join(_purge_times(purges, purge_key, purged), "key", "full_outer")


def referring_rows(child: DataFrame, id_column: str, ref_column: str, time_column: str | None) -> DataFrame:
    """(ref_id, key, at) of the rows of ``child`` that refer to something."""
    at = instant(F.col(time_column), dict(child.dtypes)[time_column]) if time_column else F.lit(None).cast("timestamp")
    return (
        child.select(F.col(id_column).cast("string").alias("ref_id"), canonical_key(F.col(ref_column), dict(child.dtypes)[ref_column]).alias("key"), at.alias("at"))
        .filter(F.col("key").isNotNull())
    )


def hot_keys(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(key, pieces) of the keys with more than ``piece_rows`` rows.

    All rows are counted, in one table of frequent items of bounded size per task, so that no key is shuffled. The counts
    are exact up to TRACKED * 3 / 4 keys and estimates beyond; they decide only how rows are spread, never the result.
    """
    top = rows.agg(F.expr(f"approx_top_k(key, {TOP}, {TRACKED})").alias("top")).selectExpr("inline(top)")
    return top.select(F.col("item").alias("key"), F.ceil(F.col("count") / piece_rows).alias("pieces")).filter("pieces > 1")


def dealt_join(rows: DataFrame, keys: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to ``keys`` by key, where the rows of a hot key are dealt out and its keys copied to each piece."""
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("piece", F.pmod(F.xxhash64("ref_id", "at"), pieces)).drop("pieces")
    copies = keys.join(F.broadcast(hot), "key", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
    return dealt.join(copies, ["key", "piece"], how).drop("piece")


def direct_orphans(child: DataFrame, id_column: str, ref_column: str, time_column: str | None, states: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(ref_id, key, at, cause) of the rows of ``child`` whose reference does not resolve.

    ``hot`` are the ``hot_keys`` of the child's references, which are counted here if not given.
    """
    rows = referring_rows(child, id_column, ref_column, time_column)
    cause = (
        F.when(F.col("arrived").isNull() & F.col("purged").isNull(), "missing")
        .when(F.col("purged") <= F.col("at"), "deleted")
        .when(F.col("arrived").isNull(), "missing")
        .when(F.col("arrived") > F.col("at"), "later")
    )
    return (
        dealt_join(rows, states, hot_keys(rows) if hot is None else hot, "left")
        .withColumn("cause", cause)
        .filter(F.col("cause").isNotNull())
        .select("ref_id", "key", "at", "cause")
        .distinct()
    )


def report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month (``YYYY-MM``, null when the row has no time), kind and cause."""
    return (
        orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"), "kind", "cause")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )


def _lost_keys(parent: DataFrame, id_column: str, key_column: str, lost: DataFrame) -> DataFrame:
    """Keys by which children refer to the rows of ``parent`` whose ids are in ``lost``."""
    if key_column == id_column:
        keys = lost.select(canonical_key(F.col("ref_id")).alias("key"))
    else:
        ids = parent.select(F.col(id_column).cast("string").alias("ref_id"), canonical_key(F.col(key_column)).alias("key"))
        keys = ids.join(lost.select("ref_id"), "ref_id", "left_semi").select("key")
    return keys.filter(F.col("key").isNotNull()).distinct()


def _tables_of(orphans: DataFrame) -> set[str]:
    return {row["ref_table"] for row in orphans.select("ref_table").distinct().collect()}


def cascade(tables: Mapping[str, DataFrame], references: Sequence[Reference], purges: Mapping[str, DataFrame] | None = None, purge_key: str = "job_id", purged: str = "purged_at", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(ref_table, ref_id, at, kind, cause) over a whole graph of foreign keys.

    Round 0 finds the direct orphans of every reference. Each further round semi-joins the children
    of the tables that gained orphans in the round before against those orphans only, and takes what
    was not known yet, until a round adds nothing. Rounds are at most the number of tables unless the
    graph has a cycle, where they end because the set of orphans only grows.
    The hot keys of a reference are counted once and dealt out in every round.
    ``kind`` is ``direct`` where the row's own reference fails, else ``inherited``.
    """
    from docan.session import checkpoint

    if not references:
        raise ValueError("no reference given")
    ids = {r.table: r.id_column for r in references}
    has_children = {r.parent for r in references} & set(ids)
    parts, linked = [], []
    for r in references:
        states = key_states(tables[r.parent], r.parent_key, r.parent_time, (purges or {}).get(r.parent), purge_key, purged)
        rows = referring_rows(tables[r.table], r.id_column, r.ref_column, r.time_column)
        hot = hot_keys(rows, piece_rows)
        if r.parent in has_children:
            hot = checkpoint(hot)
            linked.append((r, rows, hot))
        parts.append(
            direct_orphans(tables[r.table], r.id_column, r.ref_column, r.time_column, states, hot)
            .select(F.lit(r.table).alias("ref_table"), "ref_id", "at", F.lit("direct").alias("kind"), "cause")
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if not has_children:
        return found.distinct()
    found = checkpoint(found.distinct())
    frontier, gained = found, _tables_of(found)
    while gained & has_children:
        steps = []
        for r, rows, hot in linked:
            if r.parent not in gained:
                continue
            lost = _lost_keys(tables[r.parent], ids[r.parent], r.parent_key, frontier.filter(F.col("ref_table") == r.parent))
            steps.append(
                dealt_join(rows, lost, hot, "left_semi")
                .select(F.lit(r.table).alias("ref_table"), "ref_id", "at", F.lit("inherited").alias("kind"), F.lit("parent").alias("cause"))
            )
        new = steps[0]
        for t in steps[1:]:
            new = new.unionByName(t)
        known = found.select("ref_table", "ref_id").distinct()
        frontier = checkpoint(new.distinct().join(known, ["ref_table", "ref_id"], "left_anti"))
        gained = _tables_of(frontier)
        found = found.unionByName(frontier)
    return found
