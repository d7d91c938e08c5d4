"""Values, spans, types and chunks taken from text.

Values come from the JVM's regular expressions inside the scan's stage, without a Python worker;
only where positions are wanted, which count code points, is the text handed to Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docan.functions.patterns import DOCUMENT_TYPES, ENTITIES, FAILURES, FIELDS, MEMO_HEADS, SCRIPTS


def values(rows: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, kind, value): every match of every pattern (group 1), in one pass over the text."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    parts = [found(k, p) for k, p in patterns.items()]
    return rows.select(key, F.explode(F.flatten(F.array(*parts))).alias("m")).select(key, "m.kind", "m.value")


def entity_patterns() -> dict[str, str]:
    return {k: f"(?i){p}" for k, p in ENTITIES.items()}


def field_patterns() -> dict[str, str]:
    return {k: ("(?i)" if fold else "") + p for k, (p, fold) in FIELDS.items()}


def spans(rows: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, kind, value, begin, end): matches with positions in code points, in the order of the patterns."""
    kind_of_key = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(p, re.ASCII)) for k, p in patterns.items()]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, p in compiled:
                    for m in p.finditer(t or ""):
                        for column, v in zip(out, (k, kind, m.group(1), m.start(1), m.end(1))):
                            column.append(v)
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=["key", "kind", "value", "begin", "end"])

    return rows.select(key, text).mapInArrow(run, f"key {kind_of_key}, kind string, value string, begin int, end int").withColumnRenamed("key", key)


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def normalise_date(value: Column) -> Column:
    """ISO form of the four shapes of dates; no check of ranges; other text is returned trimmed."""
    v = F.trim(value)
    iso, us = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    day_first, month_first = r"^(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{4})$", r"^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$"
    part = lambda p, i: F.regexp_extract(v, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02}")))
    month = lambda c: months[F.lower(F.substring(c, 1, 3))]
    join = lambda y, m, d: F.concat_ws("-", y, m, d)
    return (
        F.when(v.rlike(iso), join(part(iso, 1), two(part(iso, 2)), two(part(iso, 3))))
        .when(v.rlike(us), join(part(us, 3), two(part(us, 1)), two(part(us, 2))))
        .when(v.rlike(day_first) & month(part(day_first, 2)).isNotNull(), join(part(day_first, 3), month(part(day_first, 2)), two(part(day_first, 1))))
        .when(v.rlike(month_first) & month(part(month_first, 1)).isNotNull(), join(part(month_first, 3), month(part(month_first, 1)), two(part(month_first, 2))))
        .otherwise(v)
    )


def _hits(text: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(f"(?i){p}").cast("int")
    return total


def type_scores(text: Column) -> dict[str, Column]:
    """Share of each type's patterns that occur; a memo needs its head lines as well."""
    scores = {}
    for kind, patterns in DOCUMENT_TYPES.items():
        score = _hits(text, patterns) / F.lit(len(patterns))
        scores[kind] = F.when(_hits(text, MEMO_HEADS) >= 2, score).otherwise(0.0) if kind == "memo" else score
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in scores.items()}


def best_type(scores: Mapping[str, Column]) -> tuple[Column, Column]:
    """Type of the greatest score, the first of equals in the order of the types, ``other`` for none; and the score."""
    top = F.greatest(*scores.values())
    kind = F.coalesce(*(F.when((c == top) & (top > 0), F.lit(k)) for k, c in scores.items()), F.lit("other"))
    return kind, top


def failure_family(message: Column) -> Column:
    """First family of error messages that matches, else ``unknown``."""
    low = F.lower(message)
    return F.coalesce(*(F.when(_hits(low, p) > 0, F.lit(k)) for k, p in FAILURES.items()), F.lit("unknown"))


def script_counts(text: Column) -> dict[str, Column]:
    return {k: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{c}]", "")) for k, c in SCRIPTS.items()}


def key_values(rows: DataFrame, key: str, text: str, longest_key: int = 80) -> DataFrame:
    """(key, line, name, value) of the lines with a colon whose part before it is not longer than allowed."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    at = F.instr("t", ":")
    name, value = F.trim(F.expr("substring(t, 1, instr(t, ':') - 1)")), F.trim(F.expr("substring(t, instr(t, ':') + 1)"))
    return lines.filter(at > 1).select(key, "line", name.alias("name"), value.alias("value")).filter((F.length("name") > 0) & (F.length("name") < longest_key) & (F.length("value") > 0))


def chunk_bounds(text: str, size: int, overlap: int, look_back: int = 50) -> list[tuple[int, int]]:
    """Chunks [begin, end) of at most ``size``, cut at a blank of the last ``look_back`` characters, overlapping."""
    out, begin, n = [], 0, len(text)
    while begin < n:
        end = min(begin + size, n)
        if end < n:
            blank = text.rfind(" ", max(begin, end - look_back), end)
            if blank > begin:
                end = blank
        if text[begin:end].strip():
            out.append((begin, end))
        if end >= n:
            break
        begin += max(1, end - begin - overlap)
    return out


def chunks(rows: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk, text): overlapping chunks; where one begins depends on where the one before was cut."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, parts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (a, b) in enumerate(chunk_bounds(t or "", size, overlap)):
                    keys.append(k)
                    index.append(i)
                    parts.append(t[a:b].strip())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=batch.schema.field(0).type), pa.array(index, type=pa.int32()), pa.array(parts, type=pa.string())], names=["key", "chunk", "text"])

    return rows.select(key, text).mapInArrow(run, f"key {kind}, chunk int, text string").withColumnRenamed("key", key)
