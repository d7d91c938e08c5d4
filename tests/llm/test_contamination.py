import pytest

from docan.llm import contamination as c
from docan.llm.words import words

DOCS = "doc_id long, text string, item_id string, n_words int"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items, n):
    found = {}
    for d, text, *_ in docs:
        a = words(text)
        for i, passage, *_ in items:
            b = words(passage)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                found[d, i] = best
    return found


def numbered(k, n, start=0):
    return " ".join(f"w{k}x{i}" for i in range(start, start + n))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "SHARD_CHARS", 300)
    items = [(1, numbered(1, 30), "x"), (2, numbered(2, 12), "x"), (3, numbered(3, 11), "x"), (4, None, None), (5, "", None), (6, numbered(1, 30), None), (None, numbered(7, 14), None)]
    docs = [
        (1, "start " + numbered(1, 13, 5).upper().replace(" ", ", ") + " end", "e", 1),
        (2, numbered(2, 11), "e", 1),
        (3, numbered(2, 12) + " " + numbered(3, 11), "e", 1),
        (4, None, None, None),
        (5, "", None, None),
        (6, numbered(1, 30) + " and " + numbered(1, 30), None, None),
        (6, numbered(1, 30) + " and " + numbered(1, 30), None, None),
        (7, numbered(7, 14), None, None),
        (8, " ".join(["filler"] * 5000) + " " + numbered(1, 12, 9), None, None),
        (9, numbered(1, 6) + " gap " + numbered(1, 6, 6), None, None),
    ]
    found = c.leaks(c.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in found.collect()}
    assert got == brute(docs, items, 12)
    assert got[7, None] == 14 and (8, 1) in got and (9, 1) not in got


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, numbered(i, 15), "x") for i in range(20)]
    docs = [(i, "lead " + numbered(i, 13, 1), "x", 0) for i in range(20)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = {(r[0], r[1], r[2]) for r in c.matches(a, b).select("doc_id", "item_id", "n_words").collect()}
    monkeypatch.setattr(c, "BLOCK_CHARS", 500)
    assert one == {(r[0], r[1], r[2]) for r in c.matches(a, b).select("doc_id", "item_id", "n_words").collect()} == {(i, i, 13) for i in range(20)}


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, numbered(1, 20), "x", 0), (2, "clean", "x", 0)], DOCS)
    items = spark.createDataFrame([(1, numbered(1, 20), "x")], ITEMS)
    assert [r["doc_id"] for r in c.remove_leaks(docs, c.matches(docs, items)).collect()] == [2]
    assert c.matches(docs.limit(0), items).count() == 0
    assert c.matches(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("text,expected", [(None, []), ("", []), ("Ab-c_d é1", ["ab", "c", "d", "é1"]), ("İx", ["i̇x"])])
def test_words(text, expected):
    assert words(text) == expected
