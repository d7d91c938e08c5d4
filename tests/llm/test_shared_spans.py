import random

import numpy as np

from docan.llm import shared_spans as s

SCHEMA = "doc_id string, text string, id long, begin string"


def brute(docs, size):
    """Characters of each record that lie in a window that another record holds."""
    held = {}
    texts = {}
    for d, t in docs:
        if d is not None and t and len(t) >= size:
            texts[d] = t
    for d, t in texts.items():
        for i in range(len(t) - size + 1):
            held.setdefault(t[i : i + size], set()).add(d)
    out = {}
    for d, t in texts.items():
        inside = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if len(held[t[i : i + size]]) > 1:
                inside[i : i + size] = True
        if inside.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(int), [0]])))
            out[d] = sorted(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


def collect(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append((r["begin"], r["end"]))
    return {k: sorted(v) for k, v in got.items()}


def run(spark, docs, size=400):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    return collect(s.stretches(df, min_chars=size))


def noise(rng, n):
    return "".join(rng.choice("abcdefgh äöü\n") for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(5)
    long = noise(rng, 2500)
    docs = [("a", noise(rng, 900) + long[:400] + noise(rng, 300)), ("b", noise(rng, 50) + "Q" + long[:399] + "Z" + noise(rng, 700)), ("c", long), ("d", noise(rng, 333) + long[100:520] + noise(rng, 10)), ("e", long[2100:]), ("f", long[2101:] + "Q"), ("g", noise(rng, 1200)), ("h", noise(rng, 100)), (None, long), ("i", None), ("j", "")]
    same = noise(rng, 450)
    docs += [("twice", same + noise(rng, 20) + same), ("twice", same + noise(rng, 20) + same)][:1]
    docs += [("x1", "\U0001f600" * 3 + noise(rng, 10) + long[600:1300]), ("x1", "\U0001f600" * 3 + noise(rng, 10) + long[600:1300])][:1] * 2
    docs += [(f"copy{i}", "=" * i + long[1500:2200] + "#" * i) for i in range(12)]
    want = brute(docs, 400)
    got = run(spark, docs)
    assert got == want
    assert "twice" not in got and "b" not in got and "e" in got


def test_repeated_characters_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 700)
    rng = random.Random(7)
    long = noise(rng, 3000)
    docs = [("a", "x" * 450), ("b", "x" * 420 + "y"), ("c", "x" * 399), ("d", long), ("e", noise(rng, 900) + long[700:1900] + noise(rng, 900))]
    assert run(spark, docs) == brute(docs, 400)


def test_shares_and_empty(spark):
    rng = random.Random(1)
    text = noise(rng, 500)
    df = spark.createDataFrame([("a", text, 1, "x"), ("b", text + "Z" * 500, 1, "x"), ("c", None, 1, "x")], SCHEMA)
    got = {r["id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in s.shares(df, s.stretches(df)).collect()}
    assert got == {"a": (500, 500, 1.0), "b": (1000, 500, 0.5), "c": (0, 0, 0.0)}
    assert s.stretches(df.limit(0)).count() == 0
