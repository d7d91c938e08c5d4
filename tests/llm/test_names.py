import pytest

from docan.llm import names as n


@pytest.mark.parametrize("a,b,value", [("martha", "marhta", 0.961), ("dixon", "dicksonx", 0.813), ("", "a", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, value):
    assert n.jaro_winkler(a, b) == pytest.approx(value, abs=0.001)


@pytest.mark.parametrize("a,b,yes", [("abc", "abc", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "abdc", True), ("abc", "axc", True), ("abc", "cba", False), ("abcd", "ab", False), ("", "a", True), ("abxd", "badx", False)])
def test_within_one(a, b, yes):
    assert n.within_one(a, b) is yes


def link(spark, rows):
    df = spark.createDataFrame([(t, x, 1, "k") for t, x in rows], "entity_type string, text string, name int, kind string")
    return {(r["kind"], r["name_a"], r["name_b"]) for r in n.linked_pairs(n.entities(df, "entity_type", "text")).collect()}


def group(kind, *names):
    s = sorted(names)
    return {(kind, a, b) for i, a in enumerate(s) for b in s[i + 1 :]}


def test_entities(spark):
    anna = ("Rebecca Kofgasteher", "Kofgasteher, Rebecca", "BECKY KOFGASTEHER", "Dr. Rebecca A. Kofgasteher", "R. Kofgasteher", "Rebecca Kofgastehr", "KOFGASTEHER Rebecca", "Rebecca Kofgástéher", "R.A. Kofgasteher")
    john = ("John von Lamsinpumer", "Jack Lamsinpumer", "von Lamsinpumer, John")
    jon = ("Jonathan von Lamsinpumer", "Jon Lamsinpumer")
    firm = ("Vapkevrir Fisheries GmbH", "Vapkevrir Fisheries", "Vapkevrir Fisheries, G.m.b.H.", "VAPKEVRIR FISH. GESELLSCHAFT MBH", "Fisheries Vapkevrir GmbH", "The Vapkevrir-Fisheries GmbH", "Vapkewrir Fisheries GmbH")
    other = ("Vapkevrir Timber Holdings", "Vapkevrir Timb. Hldgs")
    rows = [("PERSON", x) for x in anna * 2 + john + jon + ("J. Lamsinpumer", "unknown", "Unknown", "see cover sheet", "See cover sheet", "Susan Kofgasteher")]
    rows += [("ORG", x) for x in firm + other + ("as above", "As above", "Rebecca Kofgasteher")] + [(None, "Rebecca Kofgasteher"), ("PERSON", None), ("PERSON", " "), ("GPE", "Kofgasteher, Rebecca"), ("PERSON", "x" * 50000 + " y")]
    want = group("PERSON", *anna) | group("PERSON", *john) | group("PERSON", *jon) | group("ORG", *firm) | group("ORG", *other)
    assert link(spark, rows) == want


def test_initials_alone_and_empty(spark):
    assert link(spark, [("PERSON", "A. Norvikessen"), ("PERSON", "Norvikessen, A.")]) == {("PERSON", "A. Norvikessen", "Norvikessen, A.")}
    assert link(spark, []) == set()


def test_cut_trades_of_several_words_meet_their_full_spellings(spark):
    brew = ("Gurverragini Brew. Inc.", "Gurverragini Brewing Incorporated", "Brewing Gurverragini Inc")
    ship = ("Dufkibmuser Ship. Ltd", "Dufkibmuser Shipyards Limited", "Dufkibmuser Shi. Ltd")
    road = ("Vapkevrir Tra. GmbH", "Vapkevrir Trading GmbH")
    rail = ("Kofgasteher Tra. GmbH", "Kofgasteher Transport GmbH")
    assert link(spark, [("ORG", x) for x in brew + ship + road + rail]) == group("ORG", *brew) | group("ORG", *ship) | group("ORG", *road) | group("ORG", *rail)


@pytest.mark.parametrize("cut,full", [("Brew.", "Brewing"), ("Brew.", "Breweries"), ("Tra.", "Trading"), ("Tra.", "Transport"), ("Ship.", "Shipping"), ("Shi.", "Shipyards")])
def test_cut_trades_fit(cut, full):
    a, b = n.parse_firm(f"Vapkevrir {cut} Ltd"), n.parse_firm(f"Vapkevrir {full} Limited")
    assert a[1].endswith(".") and n.compare_firms(a, b) == n.compare_firms(b, a) == n.STRONG
    assert set(n.keys("ORG", a)) & set(n.keys("ORG", b))


@pytest.mark.parametrize("cut,trade", [("Phar.", "pharmaceuticals"), ("Wine.", "wines"), ("Vine.", "vineyards"), ("Loc.", "locksmiths"), ("Far.", "farms")])
def test_cut_trades_as_written(cut, trade):
    assert n.parse_firm(f"Vapkevrir {cut} Ltd")[1] == trade


def test_a_cut_trade_that_fits_two_firms_joins_none(spark):
    full = ("Vapkevrir Brewing Ltd", "Vapkevrir Breweries Ltd")
    assert link(spark, [("ORG", x) for x in full + ("Vapkevrir Brew. Ltd",)]) == set()
    assert link(spark, [("ORG", x) for x in full[:1] + ("Vapkevrir Brew. Ltd", "Brewing Vapkevrir Ltd")]) == group("ORG", full[0], "Vapkevrir Brew. Ltd", "Brewing Vapkevrir Ltd")


@pytest.mark.parametrize("size", [2, 3, 22, 23, 24, 25, 26, 27])
def test_codes_one_edit_apart_share_a_form(size):
    code = ("bkltmnprsfv" * 3)[:size]
    edited = {code[:i] + "x" + code[i:] for i in range(size + 1)} | {code[:i] + code[i + 1 :] for i in range(size)} | {code[:i] + "x" + code[i + 1 :] for i in range(size)}
    edited |= {code[:i] + code[i + 1] + code[i] + code[i + 2 :] for i in range(size - 1)}
    assert all(n.near_codes(code) & n.near_codes(e) for e in edited)


def test_long_firm_names_across_the_limit(spark):
    long = "Bnfml" * 5
    a, b = n.parse_firm(long[:-1] + " Ltd"), n.parse_firm(long + " Ltd")
    assert len(n.sound(a[0])) == n.LONG_CODE and len(n.sound(b[0])) == n.LONG_CODE + 1
    assert set(n.keys("ORG", a)) & set(n.keys("ORG", b))
