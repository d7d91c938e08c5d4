"""Evaluation passages inside a training corpus, by suffix arrays over shards of the corpus.

Every task cuts its documents into shards of a bounded number of characters and builds for each the
word-level suffix array of the positions that can start a match. Every suffix of every evaluation
item is looked up in it by binary search; neighbouring hits on one diagonal are joined to the longest
verbatim matches. No shuffle takes part: the corpus is read once, the evaluation items are a stated
query set, sent to the tasks in blocks of bounded size.

The suffix arrays are sparse and sorted to a depth of ``min_words`` words: that is all that a match of
at least that length needs to be found, and longer matches come from joining neighbouring hits.
Positions are left out of a suffix array only when no match can start there: a match of ``min_words``
words needs that many words, and all pairs of neighbouring words, to occur in the evaluation items.

Defined results
* null or empty text, or fewer than ``min_words`` words: no match, on either side;
* null ids: carried as they are;
* repeated rows: a repeated document yields its matches once per row; ``leaks`` makes them distinct;
* ties (several equally long matches): all are reported;
* very long texts: processed whole, as a shard of their own; other columns are never read;
* empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docan.llm.words import words

MIN_WORDS = 12
#: Characters of one shard's texts; bounds a task's memory.
SHARD_CHARS = 3_000_000
#: Characters of evaluation items handled per pass over the corpus; bounds what is broadcast.
BLOCK_CHARS = 20_000_000


class _Vocabulary(dict):
    def __missing__(self, key: str) -> int:
        return 0


class _Suffixes:
    """The evaluation items: word numbers from 1, and all their suffixes of at least ``n`` words, sorted."""

    def __init__(self, texts: list[str | None], n: int) -> None:
        self.n, self.vocabulary = n, _Vocabulary()
        flat: list[int] = []
        item, offset = [], []
        for k, text in enumerate(texts):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            flat += [*ids, 0]
            item += [k] * (len(ids) + 1)
            offset += range(len(ids) + 1)
        x = np.array(flat or [0], dtype=np.int64)
        starts = _starts(x, n)
        pair = x[:-1] * (len(self.vocabulary) + 1) + x[1:]
        self.pairs = np.unique(pair[(x[:-1] > 0) & (x[1:] > 0)])
        key = _keys(x, starts, n)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], np.array(item or [0])[starts][order], np.array(offset or [0])[starts][order]


def _starts(x: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` values in a row are not zero."""
    size = len(x)
    stop = np.where(x == 0, np.arange(size), size)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    return np.flatnonzero(stop - np.arange(size) >= n)


def _keys(x: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values from each start as byte strings that compare as the values do."""
    if not len(starts):
        return np.array([], dtype=f"S{4 * n}")
    window = np.ascontiguousarray(x[starts[:, None] + np.arange(n)], dtype=">u4")
    return window.view(f"S{4 * n}").ravel()


def _search(ids: list, texts: list[list[str]], suffixes: _Suffixes) -> tuple[list, ...]:
    """Longest matches of one shard: document ids, item numbers, words, first word in document and item."""
    n, at = suffixes.n, suffixes.vocabulary.__getitem__
    lengths = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    x = np.zeros(begin[-1], dtype=np.int64)
    for k, t in enumerate(texts):
        x[begin[k] : begin[k + 1] - 1] = np.fromiter(map(at, t), dtype=np.int64, count=len(t))
    known = np.zeros(len(x), dtype=np.int64)
    where = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    if len(where) and len(suffixes.pairs):
        pair = x[where] * (len(suffixes.vocabulary) + 1) + x[where + 1]
        place = np.minimum(np.searchsorted(suffixes.pairs, pair), len(suffixes.pairs) - 1)
        known[where] = suffixes.pairs[place] == pair
    starts = _starts(known, n - 1) if n > 1 else np.flatnonzero(x)
    if not len(starts) or not len(suffixes.key):
        return [], [], [], [], []
    key = _keys(x, starts, n)
    order = np.argsort(key, kind="stable")
    array, key = starts[order], key[order]  # the suffix array, and its suffixes' first n words
    low, high = np.searchsorted(key, suffixes.key, "left"), np.searchsorted(key, suffixes.key, "right")
    count = high - low
    if not count.any():
        return [], [], [], [], []
    suffix = np.repeat(np.arange(len(count)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    position = array[np.repeat(low, count) + inner]
    item, offset = suffixes.item[suffix], suffixes.offset[suffix]
    order = np.lexsort((position, position - offset, item))
    position, item, offset = position[order], item[order], offset[order]
    first = np.ones(len(position), dtype=bool)
    first[1:] = (item[1:] != item[:-1]) | (position[1:] != position[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(position))) + n - 1
    doc = np.searchsorted(begin, position[head], "right") - 1
    return [ids[k] for k in doc], item[head].tolist(), size.tolist(), (position[head] - begin[doc]).tolist(), offset[head].tolist()


def matches(corpus: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): longest verbatim matches of at least ``min_words`` words."""
    held = items.select(F.col(item_column).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    doc_type, item_type = dict(corpus.dtypes)[id_column], dict(items.dtypes)[item_column]
    schema = f"doc_id {doc_type}, item_id {item_type}, n_words int, doc_word int, item_word int"
    docs = corpus.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    found = None
    for block in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else held
        rows = part.collect()
        one = _one_block(docs, [r["item_id"] for r in rows], _Suffixes([r["text"] for r in rows], min_words), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _one_block(docs: DataFrame, item_ids: list, suffixes: _Suffixes, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, item, n, at, offset = _search(ids, texts, suffixes)
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((doc, [item_ids[k] for k in item], n, at, offset), arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids.append(doc_id)
                texts.append(words(text))
                size += len(text)
                if size >= SHARD_CHARS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(search, schema)


def leaks(found: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) with the longest match of each."""
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def remove_leaks(corpus: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``corpus`` without the documents that hold a match."""
    lost = found.select(F.col("doc_id").alias(id_column)).distinct()
    return corpus.join(lost, id_column, "left_anti")
