"""Filling containers of several permitted capacities with texts measured in tokens.

The packing is planned on the histogram of sizes, not on the items: it has at most ``capacity``
entries whatever the corpus. Sizes are taken from the largest down. For the next one every permitted
capacity is filled on trial by best fit (the size that fills the rest exactly, else two that do
together, else the largest that goes in), the capacity with the least cost per token is opened, and
the pattern is used as often as the counts allow. At the end each container is downsized to the least
permitted capacity that holds its contents. Items then find their container by their rank among the
items of their size, counted in two levels so that a size held by a third of all items is no single
task's work.

A plan is a set of permitted capacities: one model's limit, or all of them jointly.

Defined results
* null or empty text: no tokens, in no container;
* an item larger than the plan's largest capacity: cut into full containers and a rest that is packed
  like any other item; no other item is cut;
* repeated rows: one item each; null id: packed under a null id;
* ties: items of one size are interchangeable, they are ranked by id;
* empty tables: empty result; other columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docan.session import checkpoint

#: Items of one size and rank bucket that one task may rank.
BUCKET_ITEMS = 4_000_000


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(records: DataFrame, tokenizer: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every record with tokens; ``tokenizer`` is the path of a tiktoken rank file."""
    rows = records.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter("text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64())], names=["id", "n_tokens"])

    return rows.mapInArrow(count, f"id {dict(rows.dtypes)['id']}, n_tokens long").filter("n_tokens > 0")


class _Stock:
    """Counts of items by size, and the sizes that are left."""

    def __init__(self, histogram: Mapping[int, int], largest: int) -> None:
        self.count = np.zeros(largest + 1, dtype=np.int64)
        for size, n in histogram.items():
            self.count[size] += n
        self.left = np.flatnonzero(self.count)

    def refresh(self) -> None:
        self.left = self.left[self.count[self.left] > 0]

    def fill(self, capacity: int, first: int) -> tuple[dict[int, int], int]:
        """Pattern (size to how many) that begins with ``first``, and the tokens left over."""
        used = {first: 1}
        rest = capacity - first
        taken: dict[int, int] = {first: 1}

        def has(size: int) -> bool:
            return self.count[size] > taken.get(size, 0)

        def take(size: int) -> None:
            used[size] = used.get(size, 0) + 1
            taken[size] = taken.get(size, 0) + 1

        while rest > 0:
            k = int(np.searchsorted(self.left, rest, "right"))
            if k == 0:
                break
            if self.left[k - 1] == rest and has(rest):
                take(rest)
                return used, 0
            small = self.left[:k]
            mate = rest - small
            pair = small[(mate <= small) & (mate > 0)]
            pair = pair[self.count[rest - pair] > 0]
            for a in pair[::-1][:8].tolist():
                b = rest - a
                if has(a) and has(b) and (a != b or self.count[a] > taken.get(a, 0) + 1):
                    take(a)
                    take(b)
                    return used, 0
            for j in range(k - 1, -1, -1):
                size = int(self.left[j])
                if has(size):
                    many = min(rest // size, int(self.count[size]) - taken.get(size, 0))
                    # all but the last of the same size at once, so that the rest is chosen anew
                    for _ in range(max(1, many - 2) if many > 3 else 1):
                        take(size)
                        rest -= size
                    break
            else:
                break
        return used, rest


def plan_patterns(histogram: Mapping[int, int], capacities: Sequence[int]) -> list[tuple[int, int, dict[int, int]]]:
    """(capacity, containers, size to items per container) that hold every item of the histogram."""
    permitted = sorted(set(capacities))
    stock = _Stock(histogram, permitted[-1])
    patterns = []
    while len(stock.left):
        first = int(stock.left[-1])
        best = None
        for capacity in permitted:
            if capacity < first:
                continue
            used, rest = stock.fill(capacity, first)
            cost = capacity / (capacity - rest)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, capacity, used, rest)
        _, capacity, used, rest = best
        capacity = next(c for c in permitted if c >= capacity - rest)
        times = min(int(stock.count[s]) // n for s, n in used.items())
        for s, n in used.items():
            stock.count[s] -= n * times
        stock.refresh()
        patterns.append((capacity, times, used))
    return patterns


def pieces(counts: DataFrame, plans: Mapping[str, Sequence[int]]) -> DataFrame:
    """(plan, id, piece, first_token, size): items as each plan packs them."""
    top = F.create_map(*(F.lit(x) for name, caps in plans.items() for x in (name, max(caps))))
    rows = counts.withColumn("plan", F.explode(F.array(*(F.lit(p) for p in plans)))).withColumn("top", top[F.col("plan")].cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.expr("(n_tokens - 1) div top"))
    return rows.withColumn("piece", F.explode(parts)).select("plan", "id", "piece", (F.col("piece") * F.col("top")).alias("first_token"), F.least(F.col("n_tokens") - F.col("piece") * F.col("top"), F.col("top")).alias("size"))


def pack(counts: DataFrame, plans: Mapping[str, Sequence[int]]) -> DataFrame:
    """(plan, bin_id, capacity, id, piece, first_token, size): every item's container in every plan.

    ``counts`` is read several times and must therefore be cheap to read (a table or a checkpoint).
    """
    names = sorted(plans)
    if any(not 0 < c < 1 << 24 for caps in plans.values() for c in caps):
        raise ValueError("capacities must lie between 1 and 2**24 - 1")
    items = pieces(counts, {n: plans[n] for n in names})
    most = items.groupBy("plan").count().agg(F.max("count")).first()[0] or 0
    buckets = int(max(64, most // BUCKET_ITEMS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    tally = checkpoint(items.groupBy("plan", "size", "bucket").count())
    histogram: dict[str, dict[int, int]] = {n: {} for n in names}
    for row in tally.groupBy("plan", "size").agg(F.sum("count").alias("n")).collect():  # at most a capacity's entries for each plan
        histogram[row["plan"]][row["size"]] = row["n"]
    key, low, per, first_bin, cap = [], [], [], [], []
    for p, name in enumerate(names):
        used: dict[int, int] = {}
        bins = 0
        for capacity, times, pattern in plan_patterns(histogram[name], plans[name]):
            for size, n in pattern.items():
                key.append((p << 24) | size)
                low.append(used.get(size, 0))
                per.append(n)
                first_bin.append(bins)
                cap.append(capacity)
                used[size] = used.get(size, 0) + n * times
            bins += times
    order = np.lexsort((np.array(low, dtype=np.int64), np.array(key, dtype=np.int64)))
    table = [np.array(v, dtype=np.int64)[order] for v in (key, low, per, first_bin, cap)]
    ranked = _ranks(items, tally)
    return _assign(ranked, names, table)


def _ranks(items: DataFrame, tally: DataFrame) -> DataFrame:
    """Rank of each item among those of its plan and size: rank in its bucket plus the buckets before."""
    before = F.sum("count").over(Window.partitionBy("plan", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = tally.select("plan", "size", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("plan", "size", "bucket").orderBy("id", "piece")) - 1
    return items.withColumn("inside", inside).join(base, ["plan", "size", "bucket"]).select("plan", "id", "piece", "first_token", "size", (F.col("base") + F.col("inside")).alias("rank"))


def _assign(ranked: DataFrame, names: list[str], table: list[np.ndarray]) -> DataFrame:
    """Looks each rank up in the allocations, which are as few as the patterns' sizes, by binary search."""
    key, low, per, first_bin, cap = table
    number = {n: i for i, n in enumerate(names)}
    heads = {int(k): int(i) for i, k in zip(*np.unique(key, return_index=True)[::-1])} if len(key) else {}
    tails = {int(k): int(i) for k, i in zip(key.tolist(), range(1, len(key) + 1))}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plan = np.array([number[n] for n in batch.column(0).to_pylist()], dtype=np.int64)
            own = (plan << 24) | batch.column(4).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = np.zeros(len(own), dtype=np.int64)
            order = np.argsort(own, kind="stable")
            distinct, begin = np.unique(own[order], return_index=True)
            for k, a, b in zip(distinct.tolist(), begin.tolist(), [*begin.tolist()[1:], len(order)]):
                at = order[a:b]
                row[at] = heads[k] + np.searchsorted(low[heads[k] : tails[k]], rank[at], "right") - 1
            bins = first_bin[row] + (rank - low[row]) // per[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins), pa.array(cap[row]), *batch.columns[1:5]], names=["plan", "bin_id", "capacity", "id", "piece", "first_token", "size"])

    return ranked.mapInArrow(look, f"plan string, bin_id long, capacity long, id {dict(ranked.dtypes)['id']}, piece long, first_token long, size long")


def fill(packed: DataFrame) -> DataFrame:
    """Per plan and capacity: containers, tokens in them, and their share of the capacity."""
    bins = packed.groupBy("plan", "capacity", "bin_id").agg(F.sum("size").alias("tokens"))
    return bins.groupBy("plan", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
