import numpy as np
from pyspark.sql import functions as F
import pytest

from quarry.llm import language_id as lid
from quarry.llm import quality_classifier as qc
from quarry.llm.common import crc32_mod

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lid.op6_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_predictions_read_text_only_and_handle_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lid.fit(docs, crc32_mod("doc_id", 4) != 2)
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "fr"), (4, "é", "de"), (4, "x" * 3_000_000, "de"), (None, "the of and to in", "zz")]
    got = lid.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model, ["doc_id", "score"]).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, False]
    assert [r.score for r in got[:3]] == [0, 0, 0] and all(r.rejected for r in got[:3])
    assert lid.identify(docs.limit(0), model, ["doc_id"]).count() == 0
    none = lid.fit(docs.where("lang is null"), crc32_mod("doc_id", 4) != 2)
    assert none is None and {r.lang_pred for r in lid.identify(docs.limit(3), none, ["doc_id"]).collect()} == {"und"}


def test_pieces_of_a_long_text_give_the_same_counts(monkeypatch):
    text = "Ein längerer Text mit Wörtern. " * 50
    whole = lid.bucket_counts(text)
    monkeypatch.setattr(lid, "CHUNK", 64)
    assert (lid.bucket_counts(text) == whole).all()


def test_together_equals_one_by_one():
    model = lid.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(lid.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    texts = ["", "a", "ab cd", "some longer text here", "x y"]
    together = model.logits(texts)
    for t, row in zip(texts, together):
        counts = lid.bucket_counts(t)
        assert np.allclose(row, counts @ model.scores / max(1, counts.sum()))


def test_quality_held_out_accuracy_and_contract(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = qc.op7_quality_classifier(spark, SF).collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([a for a, b in held if b]) > 0.97  # clean documents stay


def test_isotonic_against_definition():
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=40) + np.linspace(0, 2, 40), rng.integers(1, 5, 40).astype(float)
    got = qc.isotonic(v, w)
    # The minimax formula of isotonic regression.
    mean = lambda i, j: (v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(got, want)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, None)]])
def test_quality_with_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some text here", "a"), (2, None, "b"), (2, "", "b"), (None, "more", None)], "doc_id long, text string, score string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    learn, fold = qc.learn_rule()
    got = qc.quality_scores(docs, frame, learn, fold, ["doc_id", "score"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[1].score == got[2].score
    assert qc.quality_scores(docs.limit(0), frame, learn, fold, ["doc_id"]).count() == 0


def test_language_predictions_against_a_plain_loop(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = lid.fit(docs, crc32_mod("doc_id", 4) != 2)
    found = {r.doc_id: r for r in lid.identify(docs, model, ["doc_id"]).collect()}
    mask = 2**32 - 1
    for row in docs.where("length(text) < 4000").collect()[:60]:
        data = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in row.text.encode()) + b" "
        total, count = np.zeros(len(model.languages)), 0
        for n in (3, 4):
            for i in range(len(data) - n + 1):
                code = n
                for b in data[i : i + n]:
                    code = (code * 0x01000193 + b) & mask
                code = ((code ^ code >> 15) * 0x2C1B3C6D) & mask
                total, count = total + model.scores[code >> 19], count + 1
        z = (total / max(1, count) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(c.isalpha() for c in row.text):
            assert found[row.doc_id].lang_pred == model.languages[int(p.argmax())]
            assert found[row.doc_id].score == pytest.approx(p.max(), abs=1e-9)


def test_training_follows_the_gradient():
    rng = np.random.default_rng(2)
    rows = [(i % 3, np.array([i % 3, 3 + i % 7], np.int32), np.array([0.5, 0.5], np.float32)) for i in range(90)]
    rng.shuffle(rows := list(rows))
    scores, bias = lid.train(rows, 3)
    assert all(int((share @ scores[at] + bias).argmax()) == c for c, at, share in rows)


def test_every_language_has_a_sample_of_its_own(spark):
    rows = [(i, f"{chr(0x410 + i % 250)}{chr(0x420 + i % 250)}{chr(0x430 + i % 250)} " * 5, f"l{i % 250}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.fit(docs, crc32_mod("doc_id", 4) != 2)
    assert len(model.languages) == 250


def test_ridge_equals_dense_least_squares(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    frame = qc.with_statistics(docs, ["doc_id"]).join(labels, "doc_id").selectExpr("__stats", "cast(quality as int) y", "cast(doc_id % 2 as int) fold")
    model = qc.fit(frame.repartition(5))
    rows = frame.where("fold = 0").collect()
    x, y = np.array([r["__stats"] for r in rows]), np.array([r.y for r in rows], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = np.sqrt(2 / qc.FEATURES) * np.cos(np.clip((x - x.mean(0)) / model.scale, -6, 6) @ model.weights + model.offsets)
    z = np.hstack([z, np.ones((len(z), 1))])
    drag = np.sqrt(qc.RIDGE * len(x)) * np.eye(qc.FEATURES + 1)[:-1]
    beta = np.linalg.lstsq(np.vstack([z, drag]), np.concatenate([y, np.zeros(qc.FEATURES)]), rcond=None)[0]
    assert np.allclose(z @ beta, model.raw(x), atol=1e-4)


def test_only_letters_make_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = lid.fit(docs, crc32_mod("doc_id", 4) != 2)
    odd = ["½", "²", "①", "Ⅷ", "12 34 _-", "", None, " \n", "ª", "ß", "中", "½ a"]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("lettered", F.lit("own"))
    got = {r.doc_id: r for r in lid.identify(frame, model, ["doc_id", "lettered", "text"]).collect()}
    assert [odd[i] for i in sorted(got) if got[i].lang_pred == "und"] == odd[:8]
    assert all(got[i].score == 0 and got[i].rejected for i in range(8)) and all(got[i].score > 0 for i in range(8, 12))
    assert [got[i].text for i in range(len(odd))] == odd and {r.lettered for r in got.values()} == {"own"}


def test_many_languages_are_bounded(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "if(id % 2 = 0, concat('l', id % 8), concat('x', id)) AS lang")
    model = lid.fit(docs, crc32_mod("doc_id", 4) != 2)
    assert len(model.languages) == lid.LANGUAGES and {"l0", "l2", "l4", "l6"} < set(model.languages)
