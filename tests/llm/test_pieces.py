import hashlib
import random

import numpy as np
import pytest

from quarry.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
ODD = ["", " ", "   a", "a  b\n\n  c", "\n a", "x\x00y", "日本語 漢字", "🙂🙂 é́", "a▁b", "aaaaaaaaaaaaaa", "<s> <0x0A>", "\r\n a", "    def f():\n        x = 1", "ab" * 400]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_odd_texts_equal_the_reference_encoder(model, reference):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdeéñ 日🙂\n-=(){};\r ") for _ in range(rng.randrange(1, 150))) for _ in range(800)]
    for text, ids in zip(texts, pieces.encode(model, texts)):
        assert list(ids) == reference.encode(text), repr(text)
        if pieces.BLANK not in text:
            assert pieces.decode(model, ids) == text.encode()


def test_small_memory_of_segments_changes_nothing(model, reference, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS_KEPT", 5)
    for text in ["some words again and again", "other words again"]:
        assert list(pieces.encode(model, [text])[0]) == reference.encode(text)


def test_texts_without_blanks_and_runs_of_blanks(model, reference):
    rng = random.Random(9)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "".join(pieces.load(pieces.DEFAULT_MODEL).id_of).replace(pieces.BLANK, "").replace("\n", "")
    texts = [pick(base64, 30_000), pick("日本語漢字かなカナ中文字", 9_000), pick("é🙂ab", 12_000), "a" * 20_000, "abc" * 7_000, prose[:40_000]]
    texts += [pick(prose, 20_000), "x" + " " * 9_000 + "y", " " * 17, "\n".join(" " * n + "def" for n in range(120)), pick("ab", 8_200) + " " + pick("ab", 50)]
    for text, ids in zip(texts, pieces.encode(model, texts)):
        assert list(ids) == reference.encode(text), text[:40]


def test_long_text_without_a_blank_in_bounded_memory(model, reference):
    import resource
    import time

    rng = random.Random(10)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2_000_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    ids = pieces.encode(model, [text])[0]
    assert pieces.decode(model, ids) == text.encode() and time.perf_counter() - began < 120
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
    assert list(ids[:1000]) == reference.encode(text[:20_000])[:1000]


def test_suffix_array_sorts_suffixes():
    raw = bytes(random.Random(1).choice(b"ab\xff") for _ in range(300)) + b"\xff" * 9
    order, _ = pieces.suffix_array(np.frombuffer(raw, np.uint8), 16)
    keys = [raw[i : i + 16] for i in order if i < 280]
    assert keys == sorted(keys)


def test_documents_nulls_and_clashing_columns(spark, model, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: r for r in pieces.encode_texts(docs, model, ["doc_id"]).collect()}
    for r in rows:
        ids = reference.encode(r.text)
        assert got[r.doc_id].ids == ids and got[r.doc_id].round_trip
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a▁b", "y"), (1, None, "x")], "doc_id long, text string, ids string")
    out = pieces.encode_texts(odd, model, ["doc_id", "ids"]).collect()
    assert [(r.doc_id, r.n_tokens, r.round_trip) for r in out][:2] == [(1, 0, True), (1, 0, True)] and not out[2].round_trip
    back = pieces.decode_ids(pieces.encode_texts(docs, model, ["doc_id"]), model, ["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in rows}
    assert pieces.encode_texts(docs.limit(0), model, ["doc_id"]).count() == 0


def test_other_kinds_of_model_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.load(str(tmp_path / "none.model"))
