import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docan.llm import packing as p

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30), st.sampled_from([[64], [64, 100], [70, 128, 512]]))
def test_patterns_hold_all_items(histogram, capacities):
    held = defaultdict(int)
    for capacity, times, pattern in p.plan_patterns(histogram, capacities):
        used = sum(s * n for s, n in pattern.items())
        assert used <= capacity and capacity in capacities
        assert not [c for c in capacities if used <= c < capacity]
        for s, n in pattern.items():
            held[s] += n * times
    assert dict(held) == histogram


def valid(rows, plans, sizes):
    bins, cover = defaultdict(int), defaultdict(list)
    caps = {}
    for plan, bin_id, cap, doc, piece, first, size in rows:
        bins[plan, bin_id] += size
        assert caps.setdefault((plan, bin_id), cap) == cap and cap in plans[plan]
        cover[plan, doc].append((first, size))
    for key, used in bins.items():
        assert used <= caps[key]
    for (plan, doc), parts in cover.items():
        top = max(plans[plan])
        want = [(a, min(top, sizes[doc] - a)) for a in range(0, sizes[doc], top)]
        assert sorted(parts) == want
    assert {d for _, d in cover} == set(sizes)
    return sum(bins.values()) / sum(caps.values())


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET_ITEMS", 10)
    rng = random.Random(3)
    sizes = {i: rng.choice([7, 7, 7, rng.randint(1, 90), rng.randint(1, 400)]) for i in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n_tokens long")
    plans = {"small": [64], "all": [64, 128, 256]}
    rows = [tuple(r) for r in p.pack(df, plans).collect()]
    assert valid(rows, plans, sizes) > 0.99
    assert p.pack(df.limit(0), plans).count() == 0


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    docs = [(1, "hello world", 0), (2, None, 0), (3, "", 0), (None, "a b c", 0), (1, "hello world", 0), (4, "word " * 20000, 0)]
    got = sorted((r["id"] or 0, r["n_tokens"]) for r in p.token_counts(spark.createDataFrame(docs, "doc_id long, text string, n_tokens int"), path, PATTERN).collect())
    assert got == [(0, 3), (1, 2), (1, 2), (4, 20001)]


@pytest.mark.parametrize("repeat", [1, 3])
def test_repeated_rows_are_items(spark, repeat):
    df = spark.createDataFrame([(1, 10)] * repeat, "id long, n_tokens long")
    assert p.pack(df, {"x": [16]}).count() == repeat
