"""Long exact spans shared between records: winnowed anchors, extended both ways.

Seeds: of every ``min_chars`` consecutive characters, winnowing selects at least one anchor (a k-gram
whose hash is the least of its window), and the same text selects the same anchors. Two records that
share a stretch of ``min_chars`` characters therefore share an anchor in it.

Extension: a shared stretch that holds the anchor at p is the window of ``min_chars`` characters
beginning at p - o, for some offset o to the left. Instead of pairing the records of an anchor,
which would be quadratic for boilerplate, the extension to both sides is decided by equality of
windows: first the two extreme offsets and the cores common to a hundred neighbouring offsets, then,
where only a core agrees, each single offset. Every step is a count of distinct records per key with
map-side combine, so a key held by a third of all records costs no more than any other.

The windows of an anchor that occur elsewhere all contain the anchor, so their union is one stretch
around it; the union over a record's anchors is exactly its text that lies in shared stretches.

Equality is that of two independent 64-bit hashes, of the window and of the anchor in it: 128 bits, by
which two of 10**13 different windows are taken for equal with a chance of 10**-12.

Defined results
* null or empty text, texts shorter than ``min_chars``: nothing shared;
* null id: the row is skipped, it cannot be named;
* repeated rows: rows of one id are one record, repetition within a record is no sharing;
* identical texts: shared in whole; ties play no part;
* very long texts: cut into overlapping pieces, every window lies in one of them;
* empty tables: empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docan.llm.key_filter import key_filter, possible
from docan.session import checkpoint

MIN_CHARS = 400
#: Offsets that share one core, and those of the second level.
STEP, FINE = 100, 10
#: Characters hashed at once; longer texts are cut into pieces that overlap by ``min_chars``.
CHUNK = 1_000_000

_U = np.uint64
_BASE_A, _BASE_B = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = (made[0], made[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class _Hashes:
    """Hashes of windows of one array of code points."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        up, self.down = _power(base, len(codes) + 1)
        value = _mix(codes.astype(_U) + _U(1))
        self.sums = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(value * up[:-1], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.sums[start + k] - self.sums[start]) * self.down[start])


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``op`` over every window of ``w`` values."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, fill, dtype=_U)
    padded[:n] = x
    table = padded.reshape(blocks, w)
    left = op.accumulate(table, axis=1).ravel()
    right = op.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _anchors(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchors of the records in ``codes``: record, position, hash, and the hashes at extreme offsets and cores."""
    k = size // 4 + 1
    w = size - k + 1
    if len(codes) < size:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, _U), []
    gram = _Hashes(codes, _BASE_A).all(k)
    n = len(gram)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    stop = end[owner]
    least = _sliding(gram, w, np.minimum, _NONE)
    least[stop[: len(least)] - np.arange(len(least)) < size] = 0  # windows that leave their record
    pad = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
    position = np.flatnonzero(_sliding(pad, w, np.maximum, _U(0))[:n] == gram)
    position = position[stop[position] - position >= k]
    wide = _Hashes(codes, _BASE_B)
    first, last = begin[owner[position]], stop[position]
    columns = []
    for offset, length in [(0, size), (w - 1, size), *((o, size - STEP + 1) for o in range(0, w, STEP))]:
        start = position - offset
        ok = (start >= first) & (start + length <= last)
        columns.append((wide.at(np.where(ok, start, 0), length), ok))
    return owner[position], position - first, gram[position], columns


def _pieces(ids: list, texts: list, size: int) -> Iterator[tuple[list, list, list]]:
    """Chunks of (ids, texts, first position in the text)."""
    some_ids, some, base, total = [], [], [], 0
    for doc, text in zip(ids, texts):
        if doc is None or text is None or len(text) < size:
            continue
        for at in range(0, max(1, len(text) - size + 1), CHUNK - size + 1):
            part = text[at : at + CHUNK]
            some_ids.append(doc)
            some.append(part)
            base.append(at)
            total += len(part)
            if total >= CHUNK:
                yield some_ids, some, base
                some_ids, some, base, total = [], [], [], 0
    if some:
        yield some_ids, some, base


def anchors(records: DataFrame, size: int) -> DataFrame:
    """(id, pos, anchor, low, high, core0, ...) of every record."""
    cores = len(range(0, size - size // 4, STEP))
    kind = dict(records.dtypes)["id"]
    names = ["low", "high", *(f"core{i}" for i in range(cores))]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, base in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size):
                lengths = np.array([len(t) for t in texts])
                end = np.cumsum(lengths)
                owner, position, gram, columns = _anchors(codes_of("".join(texts)), end - lengths, end, size)
                out = [
                    pa.array([ids[i] for i in owner], type=batch.schema.field(0).type),
                    pa.array(position + np.array(base)[owner] if len(owner) else position, type=pa.int64()),
                    pa.array(gram.view(np.int64)),
                    *(pa.array(v.view(np.int64), mask=~ok) for v, ok in columns),
                ]
                if len(owner):
                    yield pa.RecordBatch.from_arrays(out, names=["id", "pos", "anchor", *names])

    return records.mapInArrow(select, f"id {kind}, pos long, anchor long, " + ", ".join(f"{c} long" for c in names))


def _in_two(df: DataFrame, *key: str) -> DataFrame:
    """Keys that two different records hold."""
    return df.groupBy(*key).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select(*key)


#: Kinds and offsets go into the window's hash and the position's number, so that fewer columns are moved.
_KIND_STEP, _SHIFT_STEP = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _exact(texts: DataFrame, open_anchors: DataFrame, size: int) -> DataFrame:
    """(id, place, anchor, core, windows) for every ``FINE`` offsets of the cores that ``open_anchors`` names.

    place is pos * w + the first offset, core the hash common to the windows of those offsets.
    """
    w = size - size // 4
    wanted = open_anchors.groupBy("id").agg(F.collect_list(F.struct("pos", "anchor", "core")).alias("at"))  # one text's anchors
    # most texts without an open anchor stay where they are; a repeated row yields its keys again, which counts nothing twice
    joined = possible(texts, key_filter(open_anchors, "id"), "id").join(wanted, "id")
    kind = dict(texts.dtypes)["id"]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                codes = codes_of(text)
                hashes = _Hashes(codes, _BASE_B)
                first = np.arange(0, STEP, FINE)
                pos = np.repeat([a["pos"] for a in at], len(first))
                anchor = np.repeat([a["anchor"] for a in at], len(first))
                base = np.repeat([a["core"] for a in at], len(first)) * STEP + np.tile(first, len(at))
                offset = base[:, None] + np.arange(FINE)
                start = pos[:, None] - offset
                ok = (start >= 0) & (start + size <= len(codes)) & (offset < w) & (offset < (base // STEP * STEP + STEP)[:, None])
                some = ok.any(axis=1)
                if not some.any():
                    continue
                pos, anchor, base, offset, start, ok = pos[some], anchor[some], base[some], offset[some], start[some], ok[some]
                core = hashes.at(pos - base, size - FINE + 1) + base.astype(_U) * _U(_SHIFT_STEP)
                window = hashes.at(np.where(ok, start, 0), size) + offset.astype(_U) * _U(_SHIFT_STEP)
                flat = pa.array(window.view(np.int64).ravel(), mask=~ok.ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(pos), type=batch.schema.field(0).type), pa.array(pos * w + base), pa.array(anchor), pa.array(core.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, FINE), type=pa.int32()), flat)],
                    names=["id", "place", "anchor", "core", "windows"],
                )

    return joined.mapInArrow(extend, f"id {kind}, place long, anchor long, core long, windows array<long>")


def stretches(records: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, begin, end): parts of each record that lie in stretches shared with another record."""
    texts = records.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    every = anchors(texts, min_chars)  # made twice: reading the texts again moves less than keeping all anchors
    cores = [c for c in every.columns if c.startswith("core")]
    shared = checkpoint(_in_two(every.select("id", "anchor"), "anchor"))
    seeds = checkpoint(every.join(shared, "anchor", "left_semi"))
    # one row per anchor and key: kind 0 and 1 are the extreme offsets, 2.. the cores
    kinds = ["low", "high", *cores]
    mixed = lambda i, c: F.when(F.col(c).isNotNull(), F.col(c).bitwiseXOR(F.lit((i * _KIND_STEP) & 0x7FFFFFFFFFFFFFFF)))
    pairs = F.array(*(F.struct((F.col("pos") * len(kinds) + i).alias("place"), mixed(i, c).alias("window")) for i, c in enumerate(kinds)))
    keyed = seeds.select("id", "anchor", F.inline(pairs)).filter("window is not null")
    held = keyed.join(_in_two(keyed, "anchor", "window"), ["anchor", "window"], "left_semi")
    held = held.select("id", "anchor", F.expr(f"place div {len(kinds)}").alias("pos"), (F.col("place") % len(kinds)).cast("int").alias("kind"))
    state = held.groupBy("id", "pos", "anchor").agg(F.max((F.col("kind") == 0).cast("int")).alias("low"), F.max((F.col("kind") == 1).cast("int")).alias("high"), F.collect_set("kind").alias("kinds"))
    state = checkpoint(state)
    w = min_chars - min_chars // 4
    whole = state.filter("low = 1 and high = 1").select("id", (F.col("pos") - (w - 1)).alias("begin"), (F.col("pos") + min_chars).alias("end"))
    open_anchors = state.filter("low = 0 or high = 0").select("id", "pos", "anchor", F.explode(F.filter("kinds", lambda x: x >= 2)).alias("kind")).select("id", "pos", "anchor", (F.col("kind") - 2).cast("long").alias("core"))
    coarse = checkpoint(_exact(texts, open_anchors, min_chars))
    # of the offsets with a common core, those whose core agrees are looked at one by one
    kept = checkpoint(coarse.join(_in_two(coarse, "anchor", "core"), ["anchor", "core"], "left_semi").select("id", "place", "anchor", "windows"))
    fine = kept.select("id", "anchor", "place", F.posexplode("windows").alias("i", "window")).filter("window is not null").select("id", (F.col("place") + F.col("i")).alias("place"), "anchor", "window")
    part = (
        fine.join(_in_two(fine, "anchor", "window"), ["anchor", "window"], "left_semi")
        .select("id", F.expr(f"place div {w}").alias("pos"), (F.col("place") % w).alias("shift"))
        .groupBy("id", "pos")
        .agg(F.max("shift").alias("far"), F.min("shift").alias("near"))
        .select("id", (F.col("pos") - F.col("far")).alias("begin"), (F.col("pos") - F.col("near") + min_chars).alias("end"))
    )
    return merge(reduce(DataFrame.unionByName, [whole, part]))


def merge(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of each id joined to one."""
    order = Window.partitionBy("id").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.distinct().withColumn("fresh", F.coalesce((F.col("begin") > before).cast("int"), F.lit(1)))
    return (
        marked.withColumn("island", F.sum("fresh").over(order))
        .groupBy("id", "island")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .select("id", "begin", "end")
    )


def shares(records: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, share) of every record; the longest text counts where an id repeats."""
    sizes = records.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.coalesce(F.length(F.col(text_column)), F.lit(0))).cast("long").alias("n_chars"))
    covered = found.groupBy("id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared_chars"))
    total = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return sizes.join(covered, "id", "left").select("id", "n_chars", total.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, total / F.col("n_chars")).otherwise(0.0), 6).alias("share"))
