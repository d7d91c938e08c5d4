"""Filtered, ordered and vector searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors compared in one pass; more are taken in further passes.
QUERY_BLOCK = 4096


def contains_text(column: Column, needle: str) -> Column:
    """Whether the needle occurs, ASCII letters alike in both cases, ``%`` and ``_`` literally."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def entity_search(rows: DataFrame, kind: str | None = None, needle: str | None = None, job: str | None = None, allowed: DataFrame | Sequence[str] | None = None, least: float | None = None) -> DataFrame:
    """Rows that pass every given filter; a named job goes before the allowed ones; an empty list allows nothing."""
    if kind is not None:
        rows = rows.filter(F.col("entity_type") == kind)
    if needle is not None:
        rows = rows.filter(contains_text(F.col("text"), needle))
    if least is not None:
        rows = rows.filter(F.col("confidence") >= least)
    if job is not None:
        return rows.filter(F.col("job_id") == job)
    if isinstance(allowed, DataFrame):
        return rows.join(allowed, "job_id", "left_semi")
    return rows.filter(F.col("job_id").isin(list(allowed))) if allowed is not None else rows


def page_of(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def top_k(rows: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """(query_id, id, rank, score): the k rows of greatest cosine for every query vector, ties by id.

    Queries are a stated set and go to the tasks in blocks of bounded size; each task keeps its own
    best k of a query, so that only k rows per query and task are shuffled.
    """
    kind = dict(rows.dtypes)[id_column]
    data = queries.select(F.col(id_column), F.col(vector)).filter(F.col(vector).isNotNull())
    listed = [(r[0], np.array(r[1], dtype=np.float64)) for r in data.orderBy(id_column).collect()]
    best = None
    for at in range(0, max(len(listed), 1), QUERY_BLOCK):
        one = _best_of_tasks(rows.select(id_column, vector), listed[at : at + QUERY_BLOCK], kind, k, itself)
        best = one if best is None else best.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def _best_of_tasks(rows: DataFrame, listed: list, kind: str, k: int, itself: bool) -> DataFrame:
    ids = [q for q, _ in listed]
    sizes = {len(v) for _, v in listed}
    by_size = {n: [i for i, (_, v) in enumerate(listed) if len(v) == n] for n in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, object]]] = [[] for _ in ids]
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            keys, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, members in by_size.items():
                own = [i for i, v in enumerate(vectors) if v is not None and len(v) == n]
                if not own:
                    continue
                m = np.array([vectors[i] for i in own], dtype=np.float64)
                q = np.stack([listed[j][1] for j in members])
                norm = np.linalg.norm(m, axis=1)[None, :] * np.linalg.norm(q, axis=1)[:, None]
                score = np.divide(q @ m.T, norm, out=np.zeros_like(norm), where=norm > 0)
                for row, j in enumerate(members):
                    s = score[row]
                    cut = np.partition(s, -min(k + 1, len(s)))[-min(k + 1, len(s))]
                    held[j] += [(-float(s[i]), keys[own[i]]) for i in np.flatnonzero(s >= cut) if itself or keys[own[i]] != ids[j]]
                    held[j] = sorted(held[j])[:k]
        if arrow is not None:
            flat = [(ids[j], key, -s) for j, h in enumerate(held) for s, key in h]
            columns = list(zip(*flat)) if flat else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=arrow), pa.array(columns[1], type=arrow), pa.array(columns[2], type=pa.float64())], names=["query_id", "id", "score"])

    return rows.mapInArrow(run, f"query_id {kind}, id {kind}, score double")
