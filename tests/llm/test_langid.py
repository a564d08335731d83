import numpy as np
from pyspark.sql import functions as F

from leafspark.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    test = [r for r in got if r.held_out]
    assert 0.1 < len(test) / len(got) < 0.3
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in L._init(3, rng).items()}
    seq = rng.integers(0, 256, (7, 4))
    grad = rng.normal(size=(7, 4, L.HIDDEN)).astype(np.float32)

    def loss(u):
        out, _ = L._states(seq, model["xf"].astype(np.float32), u.astype(np.float32), model["cf"].astype(np.float32))
        return float((out[1:] * grad).sum())

    out, saved = L._states(seq, model["xf"].astype(np.float32), model["uf"].astype(np.float32), model["cf"].astype(np.float32))
    _, gu, _ = L._back(seq, out, saved, grad, model["uf"].astype(np.float32))
    for i, j in [(0, 0), (3, 9), (7, 20)]:
        step = np.zeros_like(model["uf"])
        step[i, j] = 1e-2
        assert abs((loss(model["uf"] + step) - loss(model["uf"] - step)) / 2e-2 - gu[i, j]) < 0.05 * (1 + abs(gu[i, j]))


def test_fast_states_equal_training_states():
    rng = np.random.default_rng(1)
    model = L._init(2, rng)
    seq = rng.integers(0, 257, (9, 5))
    out, _ = L._states(seq, model["xf"], model["uf"], model["cf"])
    ready = L._ready(model)
    fast = L._run(seq, ready["xf"], ready["uf"], ready["cf"], False)
    assert np.allclose(out[1:], fast.transpose(0, 2, 1), atol=1e-5)


def test_odd_rows(spark, odd, empty):
    rows = L.predict_language(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    assert by[7].lang_pred in ("en", "fr")
    assert L.predict_language(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.predict_language(unlabelled).collect()} == {"und"}


def test_signs_that_are_no_letters(spark):
    """Numbers such as halves, powers and circles are no letters; category L is."""
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(40)] + [(100 + i, f"der Hund und die Katze {i}", "de") for i in range(40)]
    rows += [(1000, "½ ² ①", None), (1001, "123 !?", None), (1002, "½ª", None), (1003, "́ ⃝", None), (1004, "日", None)]
    got = {r.doc_id: r for r in L.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred == "und" for i in range(1000, 1005)] == [True, True, False, True, False]
    assert got[1000].score == 0.0


def test_rare_languages_and_the_ends_of_long_texts_are_learned(spark):
    filler = "1234567890 " * 2000
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en") for i in range(3000)]
    rows += [(9000 + i, filler + "zwei Hunde und eine Katze liegen im Garten " * 40, "de") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = L.train_on(docs, per_language=50)
    assert trained["languages"] == ["de", "en"]
    asked = spark.createDataFrame([(1, "eine Katze und zwei Hunde im Garten", "en"), (2, "the dog sat on the mat", "de")], docs.schema)
    assert [r.lang_pred for r in L.predict_language(asked, trained).orderBy("doc_id").collect()] == ["de", "en"]


def test_a_very_long_text_is_pooled_over_all_its_bytes():
    rng = np.random.default_rng(3)
    model = L._init(2, rng)
    text = rng.integers(32, 127, 96 * 5000 + 17).astype(np.uint8)
    whole = L.probabilities(text, np.array([0, len(text)]), model)[0]
    cut = 96 * 1234
    parts = L.probabilities(text, np.array([0, cut, len(text)]), model)
    assert np.allclose(whole, (parts[0] * cut + parts[1] * (len(text) - cut)) / len(text))
