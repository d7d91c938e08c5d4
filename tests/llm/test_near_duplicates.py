import random
from fractions import Fraction
from itertools import combinations

import pytest

from docan.llm.components import components
from docan.llm.near_duplicates import NearDuplicates
from docan.llm.words import words

SCHEMA = "doc string, body string, id long, key string, n int"


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k, t):
    found = set()
    for (a, x), (b, y) in combinations(docs, 2):
        if a is None or b is None or a == b or not words(x) or not words(y):
            continue
        s, u = shingles(x, k), shingles(y, k)
        if (s or u) and Fraction(len(s & u), len(s | u)) >= t or x == y:
            found.add((min(a, b), max(a, b)))
    return found


def corpus(rng):
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    docs = []
    for i, text in enumerate(base):
        docs.append((f"d{i:03}", text))
        for j in range(5):
            w = text.split()
            for _ in range(j * 2):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 2)] = [f"e{rng.randint(0, 50)}"] * rng.randint(0, 2)
            docs.append((f"d{i:03}x{j}", " ".join(w)))
    docs += [("s1", "Short"), ("s2", "Short"), ("s3", "short text"), ("e", ""), ("n", None), (None, base[0]), ("p", "..."), ("q", "..."), ("d000", base[0]), ("t1", "One two  three four."), ("t2", "one, two three FOUR")]
    docs += [("long1", "word " * 9000 + "x"), ("long2", "word " * 9000 + "x y")]
    return docs


@pytest.mark.parametrize("k,t", [(3, Fraction(3, 5)), (5, Fraction(4, 5))])
def test_against_brute_force(spark, k, t):
    docs = corpus(random.Random(k))
    df = spark.createDataFrame([(d, x, 1, "k", 2) for d, x in docs], SCHEMA)
    got = {(r[0], r[1]) for r in NearDuplicates(df, "doc", "body", k, t).id_pairs().collect()}
    want = brute(docs, k, t)
    assert got == want and len(want) > 20


def test_groups_follow_pairs(spark):
    docs = [(d, x) for d, x in corpus(random.Random(9)) if d]
    df = spark.createDataFrame([(d, x, 1, "k", 2) for d, x in docs], SCHEMA)
    run = NearDuplicates(df, "doc", "body", 3, Fraction(3, 5))
    group = {r["id"]: r["group_id"] for r in run.groups().collect()}
    parent = {d: d for d in group}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in run.id_pairs().collect():
        parent[root(a)] = root(b)
    assert len({root(d) for d in group}) == len(set(group.values()))
    assert all((root(a) == root(b)) == (group[a] == group[b]) for a, b in combinations(group, 2))
    assert NearDuplicates(df.limit(0), "doc", "body").id_pairs().count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150)) and got[201] == got[200] == 200
