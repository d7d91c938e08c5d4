import pytest

from docan.llm import lookalikes as k


@pytest.mark.parametrize(
    "text,plain,counts",
    [
        (None, None, (0, 0, 0, 0, 0, 0)),
        ("", "", (0, 0, 0, 0, 0, 0)),
        ("plain\nascii", "plain\nascii", (0, 0, 0, 0, 0, 0)),
        ("ｆｕｌｌ １２", "full 12", (6, 0, 0, 0, 0, 0)),
        ("café x́", "café x́", (0, 1, 0, 0, 0, 0)),
        ("K­l​ä᠎ger", "Kläger", (0, 0, 3, 0, 0, 0)),
        ("the сertifіed copy", "the certified copy", (0, 0, 0, 1, 0, 0)),
        ("a b‑c d ﬁle", "a b-c d file", (4, 0, 0, 0, 0, 0)),
        ("za\ufeffb", "zab", (0, 0, 1, 0, 0, 0)),
        ("он сказал: да", "он сказал: да", (0, 0, 0, 0, 0, 0)),
        ("法院审查了，信件。", "法院审查了，信件。", (0, 0, 0, 0, 0, 0)),
        ("Арендaтор", "Арендатор", (0, 0, 0, 1, 0, 0)),
        ("the сор here and there", "the cop here and there", (0, 0, 0, 0, 1, 0)),
        ("the раураӏ account", "the paypal account", (0, 0, 0, 0, 1, 0)),
        ("the сор said: здание here and there", "the сор said: здание here and there", (0, 0, 0, 0, 1, 0)),
        ("an α ray", "an α ray", (0, 0, 0, 0, 1, 0)),
        ("Ꭰavid signed", "David signed", (0, 0, 0, 0, 0, 1)),
        ("déjà vu, Größe, ñ", "déjà vu, Größe, ñ", (0, 0, 0, 0, 0, 0)),
        ("Ινdex", "Ivdex", (0, 0, 0, 1, 0, 0)),
    ],
)
def test_forms(text, plain, counts):
    got = k.normalise(text)
    assert got[0] == plain and got[1:] == counts


def test_normalising_twice_changes_nothing():
    for text in ["сertifіed ﬁ​ é", "ｅｌ Арендaтор"]:
        once = k.normalise(text)[0]
        assert k.normalise(once)[0] == once and sum(k.normalise(once)[1:5]) == 0 and k.normalise(once)[6] == 0


def test_every_decomposed_variant_has_a_plain_form():
    assert k.PLAIN["ﬁ"] == "fi" and k.PLAIN["\u00a0"] == " " and k.PLAIN["Ａ"] == "A" and "é" not in k.PLAIN


def test_resolved_scripts():
    assert k.resolved("abc") == {"Latin"} and k.resolved("aб") == frozenset()
    assert "Jpan" in k.resolved("漢かな") and k.resolved("123") == {"*"}


def test_frame(spark):
    df = spark.createDataFrame([("a", "ｘ", 1, 5), ("a", "ｘ", 1, 5), (None, None, 2, 6), ("b", "y" * 200000 + "é", 3, 7)], "key string, body string, text int, variants int")
    rows = k.consistent(df, ["key"], "body").collect()
    assert sorted((r["key"] or "", r["variants"]) for r in rows) == [("", 0), ("a", 1), ("a", 1), ("b", 0)]
    assert k.consistent(df.limit(0), ["key"], "body").count() == 0
