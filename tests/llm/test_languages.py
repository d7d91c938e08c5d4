import random

import pytest

from docan.llm import languages as g

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def samples():
    import pyarrow.parquet as pq

    table = pq.read_table(SAMPLES)
    return list(zip(table["language"].to_pylist(), table["text"].to_pylist()))


def test_held_out_accuracy(samples):
    random.Random(2).shuffle(samples)
    right = total = 0
    for fold in range(5):
        held = samples[fold::5]
        model = g.Centroids([s for i, s in enumerate(samples) if i % 5 != fold])
        for (language, _), (got, confidence) in zip(held, model.nearest([t for _, t in held])):
            total += 1
            right += got == language
            assert 0 <= confidence <= 1
    assert right / total >= 0.98


def test_rejection(samples):
    model = g.Centroids(samples)
    assert model.nearest(["Dyrektor podpisał umowę i przesłał dokumenty do archiwum"])[0][0] is None
    assert g.Centroids([]).nearest(["some text"]) == [(None, 0.0)]


@pytest.mark.parametrize("label,code", [(None, None), ("", None), (" ", None), ("und", None), ("xx", None), ("unknown", None), ("deu", "de"), ("de-AT", "de"), ("English", "en"), ("zh-Hans", "zh"), ("EN", "en"), ("pl", "pl"), ("12?", None)])
def test_labels(label, code):
    assert g.label_language(label) == code


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("Bona fide.", 0), ("--- 12 ---", 0), ("One two three four. Five six seven eight!", 2), ("租户签署了缺失的会议记录。", 1), ("A b c d / e f g h", 2)])
def test_cut(text, n):
    assert len(g.cut(text)) == n


def test_frame(spark, samples):
    model = g.Centroids(samples)
    de, fr = next(t for c, t in samples if c == "de"), next(t for c, t in samples if c == "fr")
    rows = [
        ("d", "1", "de", de, "x"), ("d", "1", "de", de, "x"), ("d", "2", None, de, "x"), ("d", "3", "fra", de, "x"), ("d", "4", "fr", f"{fr} / {de}", "x"),
        ("d", "5", None, "Bona fide.", "x"), ("d", "6", "German", de.upper(), "x"), (None, None, "fr", None, None), ("d", "7", "", "", ""), ("d", "8", "en", (de + " ") * 3000, "x"),
    ]
    df = spark.createDataFrame(rows, "document_id string, span_id string, label string, body string, segments string")
    got = {r["span_id"]: (r["kind"], r["languages"], len(r["segments"])) for r in g.verdicts(df, ["document_id", "span_id"], "label", "body", model).collect()}
    assert got == {
        "1": ("right", ["de"], 1), "2": ("missing", ["de"], 1), "3": ("wrong", ["de"], 1), "4": ("mixed", ["de", "fr"], 2), "5": ("no sentence", [], 0),
        "6": ("right", ["de"], 1), None: ("no sentence", [], 0), "7": ("no sentence", [], 0), "8": ("wrong", ["de"], 1),
    }
    assert g.verdicts(df.limit(0), ["document_id", "span_id"], "label", "body", model).count() == 0


def test_spans_without_a_sentence_have_a_guess(spark, samples):
    model = g.Centroids(samples)
    rows = [("1", "Der Vertrag"), ("2", "12 / 40"), ("3", None), ("4", "")]
    got = {r["id"]: r["guess"] for r in g.segments(spark.createDataFrame(rows, "id string, body string"), ["id"], "body", model).collect()}
    assert got["1"]["language"] == "de" and 0 < got["1"]["confidence"] <= 0.5
    assert got["2"] is None and got["3"] is None and got["4"] is None


def test_positions_are_those_of_the_stored_text(spark, samples):
    model = g.Centroids(samples)
    de, fr = next(t for c, t in samples if c == "de"), next(t for c, t in samples if c == "fr")
    text = "\u200b" + de.replace("e", "e\u00ad", 3) + " / " + fr
    (row,) = g.segments(spark.createDataFrame([("1", text)], "id string, body string"), ["id"], "body", model).collect()
    first, second = row["segments"]
    assert text[second["begin"] : second["end"]] == fr and text[first["begin"] : first["end"]].replace("\u00ad", "") == de


def test_sparse_vectors(samples):
    texts = [t for _, t in samples[:7]] + [""]
    who, what, weight = g._weights(texts)
    rows = g._Vectors(len(texts), who, what, weight)
    dense = g.np.stack([rows.row(k) for k in range(len(texts))])
    table = g.np.random.default_rng(1).random((g.DIMENSIONS, 3)).astype("float32")
    assert g.np.allclose(rows.dot(table), dense @ table, atol=1e-4)
    group = g.np.array([0, 1, 0, 1, 2, 2, 0, 1])
    want = g.np.stack([dense[group == k].sum(axis=0) for k in range(3)])
    assert g.np.allclose(rows.sums(group, 3), want / g.np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)
    assert g.np.allclose(rows[g.np.array([1, 3])].row(1), dense[3])
