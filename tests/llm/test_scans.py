from itertools import product

import pytest

from docan.llm import scans as s

COUNTS = {w: 400 for w in "the turned clerk because furnace modern matter letter archive written attached before order would court house count early sealed register".split()}


@pytest.fixture(scope="module")
def reader():
    return s.Reader(COUNTS)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_candidates_are_complete():
    words = ["".join(p) for n in (1, 2, 3) for p in product("abc", repeat=n)]
    trie = s.Trie({w: 1 for w in words})
    for query in ["", "a", "ab", "abc", "cab", "abca", "zzz"]:
        assert {w for w, _, _ in trie.near(query)} == {w for w in words if levenshtein(s.fold(w), query) <= 1}


def group_readings(word):
    """Every reading of a word whose signs are letters, by taking any of its groups for their letters."""
    if not word:
        return {""}
    out = {word[0] + r for r in group_readings(word[1:])}
    return out | {letter + r for group, letter in (("rn", "m"), ("cl", "d"), ("ll", "u"), ("rl", "n"), ("vv", "w")) if word.startswith(group) for r in group_readings(word[2:])}


def test_candidates_are_complete_under_groups():
    words = ["".join(p) for n in (1, 2, 3, 4) for p in product("cldi", repeat=n)]
    trie = s.Trie({w: 1 for w in words})
    forms = {w: group_readings(s.fold(w)) for w in words}
    for query in ["cl", "d", "c1", "cil", "dcl", "clcl", "il1"]:
        own = group_readings(s.fold(query))
        least = {w: min(levenshtein(a, b) for a in forms[w] for b in own) for w in words}
        found = trie.near(s.fold(query))
        assert {w for w, n in least.items() if n <= 1} <= {w for w, _, _ in found}
        assert {w for w, a, b in found if not a and not b} >= {w for w, n in least.items() if n == 0}


SIGN_COUNTS = {w: 400 for w in "clerk disclosed private tribunal claim close arrived spring during house".split()}


@pytest.mark.parametrize("token,right", [("c1erk", "clerk"), ("disc1osed", "disclosed"), ("prlvate", "private"), ("tr1bunal", "tribunal"), ("c1aim", "claim"), ("arrlved", "arrived"), ("arnved", "arrived"), ("sprlng", "spring"), ("hoi1se", "house"), ("derk", "clerk")])
def test_signs_misread_inside_groups(token, right):
    assert s.Reader(SIGN_COUNTS).misread(token)[:1] == (right,)


@pytest.mark.parametrize("token,right", [("tumed", "turned"), ("derk", "clerk"), ("fumace", "furnace"), ("furn@ce", "furnace"), ("wntten", "written"), ("lette~", "letter"), ("bcfore", "before"), ("c0urt", "court"), ("attacbed", "attached"), ("hoiise", "house")])
def test_misread(reader, token, right):
    assert reader.misread(token)[:1] == (right,)


@pytest.mark.parametrize("token", ["the", "turned", "Kevzovmus", "kevzovmus", "2019", "a1", "zebra"])
def test_right_words(reader, token):
    assert reader.misread(token) == ()


@pytest.mark.parametrize("line,yes", [("- 12 -", True), ("p. 4", True), ("[3]", True), ("Page 4 of 4", True), ("ii", True), ("cxlvii", True), ("5", True), ("3/17", True), ("Seite 2 von 9", True), ("Pagc 1 of 3", True), ("1. private voucher", False), ("mix it", False), ("EUR 12", False), ("", False), ("dill", False), ("12/03/2019", False), ("---", False)])
def test_page_numbers(line, yes):
    assert s.page_number(line) is yes


def page(head, body, foot):
    return "\n".join(x for x in (head, body, foot) if x)


def test_kinds(reader):
    clean = "The clerk turned.\n\n1. sealed order\n2. early matter\n\nA well-known letter."
    assert s.noise(clean, reader) == []
    assert s.noise(None, reader) == [] and s.noise("", reader) == []
    assert s.noise("the clerk turn-\ned the modern let¬\nter", reader) == ["hyphen"]
    assert s.noise("the clerk tumed before", reader) == ["misread"]
    doc = "\n\n".join([page("EARLY COURT ORDER", "the clerk turned the", "- 1 -"), page("EARLY C0URT ORDER", "letter because the court", "- 2 -")])
    assert s.noise(doc, reader) == ["header", "pageno"]
    assert s.noise("EARLY COURT ORDER\n\nthe clerk turned\n\nthe letter", reader) == []
    assert s.noise("the clerk\nEarly Order - Court Letter   p. 7\n\nturned the\nEarly Order - Court Letter   p. 8", reader) == ["header", "pageno"]


def test_halves_at_page_ends_are_no_misread_words(reader):
    assert s.noise("tter of the court and the let-", reader, set(), False, True) == ["hyphen"]
    assert s.noise("tbe of the court", reader, set(), False, True) == []
    assert s.noise("tbe house was old", reader, set(), False) == ["misread"]
    assert s.noise("c0urt order and the house", reader, set(), False, True) == ["misread"]


def test_repair(reader):
    doc = "\n\n".join([page("EARLY COURT ORDER", "The clerk tumed the let-\nter be-", "- 1 -"), page("EARLY COURT ORDER", "cause the court.\n\nThe furn@ce.", "- 2 -")])
    assert s.repair(doc, reader) == "The clerk turned the letter because the court.\n\nThe furnace."
    assert s.repair(None, reader) is None


def test_context_ranks_candidates():
    reader = s.Reader({"house": 500, "mouse": 500, "hause": 500, "the": 900})
    assert len(reader.misread("h~use")) == 2
    assert s.repair("the h~use", reader) == "the hause"  # a tie: the first by code point
    assert s.repair("the h~use", reader, {("h~use", "the", ""): "house"}) == "the house"


def test_frames(spark):
    rows = [("p1", "d", page("EARLY COURT ORDER", "the clerk", "1")), ("p2", "d", page("EARLY COURT 0RDER", "turn-", "2")), ("p2", "d", page("EARLY COURT 0RDER", "turn-", "2")), ("p3", "e", page("EARLY COURT ORDER", "the", None)), ("p4", None, page("EARLY COURT ORDER", "the", None)), ("p5", "e", None), (None, "e", "")]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page string, doc_name string, body string, doc int")
    headed = pages.withColumnRenamed("doc", "other").join(s.running_headers(pages, "doc_name", "page", "body"), pages["doc_name"] == s.F.col("doc"), "left")
    surveyed = s.surveyed(headed.select(s.F.col("page").alias("key"), s.F.col("doc_name").alias("doc"), "page", s.F.col("body").alias("text"), "headers"), frozenset(), False)
    assert {(r["key"], tuple(r["kinds"])) for r in surveyed.collect()} == {("p1", ("header", "pageno")), ("p2", ("header", "hyphen", "pageno")), ("p3", ()), ("p4", ()), ("p5", ()), (None, ())}
    counts = s.word_counts(spark.createDataFrame([("the clerk the",), ("The turn-\ned",), (None,)], "t string"), "t")
    assert {tuple(r) for r in counts.collect()} == {("the", 3), ("clerk", 1), ("turned", 1)}
    assert s.word_counts(pages.limit(0), "body").count() == 0
    texts = spark.createDataFrame([("The clerk the clerk turn-\ned",), (None,)], "t string")
    wanted = spark.createDataFrame([("the", "clerk"), ("clerk", "turned"), ("clerk", "none")], "a string, b string")
    assert {tuple(r) for r in s.neighbours(texts, "t", wanted).collect()} == {("the", "clerk", 2), ("clerk", "turned", 1)}


def test_first_words_after_breaks(spark):
    rows = [("p1", "d", 1, "the let-"), ("p2", "d", 2, "tbe house"), ("p3", "d", 3, "tbe court"), ("p4", None, 4, "tbe court"), ("p4", None, 4, "tbe court")]
    pages = spark.createDataFrame([(*r, None) for r in rows], "key string, doc string, page int, text string, headers array<string>")
    got = s.with_first(s.surveyed(pages, frozenset(["house", "court", "the"]), False)).collect()
    assert {(r["key"], tuple(r["tokens"])) for r in got} == {("p1", ()), ("p2", ()), ("p3", ("tbe",)), ("p4", ("tbe",))}


def test_words_one_edit_apart_share_a_shard():
    words = ["".join(p) for n in (2, 3, 4, 5) for p in product("clrn", repeat=n)][::7]
    trie = s.Trie({w: 1 for w in words})
    for query in ["clcl", "c1n", "mrn", "dcll", "rlrn", "llcn", "ncr"]:
        for found, _, _ in trie.near(s.fold(query)):
            assert s.shards(query) & s.shards(found), (query, found)


CORPUS = {**COUNTS, "tumed": 3, "fare": 9, "tare": 100, "hause": 2, "letter": 5000, "lettcr": 60, "bearing": 4, "hearing": 40}


def by_shards(spark, tokens, counts):
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    asked = spark.createDataFrame([(t, counts.get(t, 0)) for t in tokens], "token string, n long")
    return {r["token"]: tuple(r["candidates"]) for r in s.candidates(asked, table).collect()}


def test_shards_find_what_one_trie_finds(spark):
    tokens = [*CORPUS, "tbe", "derk", "furn@ce", "lette~", "hoiise", "c0urt", "modem", "zebra", "attacbed", "wntten"]
    reader = s.Reader({w: n for w, n in CORPUS.items() if n >= s.LEAST})
    want = {}
    for t in tokens:
        reader.counts[t] = CORPUS.get(t, 0)
        if reader.misread(t):
            want[t] = reader.misread(t)
    assert by_shards(spark, tokens, CORPUS) == want
    assert want["tumed"] == ("turned",) and want["lettcr"] == ("letter",)
    assert "fare" not in want and "bearing" not in want  # rare, but not rare enough beside their neighbours


def test_verdicts_do_not_depend_on_other_texts(spark):
    tokens = ["tumed", "fare", "tbe", "lettcr", "bearing", "zebra"]
    first = by_shards(spark, tokens, CORPUS)
    for times in (1, 100):
        other = {f"q{chr(97 + i % 26)}{chr(97 + i // 26)}zzq": 7 * times for i in range(300)}
        assert by_shards(spark, tokens, {**CORPUS, **other}) == first
    assert by_shards(spark, tokens, {w: 100 * n for w, n in CORPUS.items()}) == first
