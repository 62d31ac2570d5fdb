from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm.common import written
from quarry.llm.pieces import DEFAULT_MODEL
from quarry.llm.quality_classifier import op7_quality_classifier
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs := written(stage(spark, docs, SF), "stage"))
    return out


def key(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text.strip(BLANKS))


def test_columns_pass_through(stages):
    for out in stages[1:-1]:
        assert out.dtypes == stages[0].dtypes


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    kept = {r.doc_id for r in op7_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert Counter(r.doc_id for r in stages[1].collect()) == Counter(kept)


def test_lines_against_brute_force(stages):
    docs = {r.doc_id: r.text.split("\n") for r in stages[1].collect()}
    holders = {}
    for i, lines in docs.items():
        for k in {key(x) for x in lines}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    lost = {k: max(at) for k, at in holders.items() if len(at) >= 5}
    want = {i: "\n".join(x for x in ls if key(x) not in lost or lost[key(x)] == i) for i, ls in docs.items()}
    rows = stages[2].collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter({c for _, c in brute(rows)})


def test_mixing_keeps_every_document_and_repeats_some(stages):
    before, after = Counter(r.doc_id for r in stages[3].collect()), Counter(r.doc_id for r in stages[4].collect())
    assert before.keys() == after.keys() and max(after.values()) > 1


def test_tokens_against_the_reference_encoder(stages):
    reference = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=DEFAULT_MODEL)
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    assert all(r.ids == reference.encode(text[r.doc_id]) and r.round_trip for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.ids_sha256) for r in stages[5].collect())


def test_mixing_copies_against_the_fitted_rates(spark, stages):
    from quarry.llm.mixing import mixing_rates

    before = stages[3]
    covered = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").distinct()
    labelled = before.select("doc_id", "text", "lang").join(covered, "doc_id", "left_semi")
    mixed = mixing_rates(before, labelled, ["doc_id"])
    want = {r.doc_id: max(1, r.copies) for r in mixed.rows.collect()}
    assert mixed.met and Counter(r.doc_id for r in stages[4].collect()) == Counter(want)


def test_odd_documents_and_an_empty_table(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, "a b " * 60_000, None, "s", 240_000), (9003, "x", "zz", "s", 1)]
    docs = base.limit(60).union(spark.createDataFrame(odd, base.schema)).selectExpr("*", "1 AS __k", "'t' AS __lines", "2 AS label")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), "odd")
            assert name == "SentencePiece" or now.columns == docs.columns
        assert frame is docs or now.count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["__k", "__id", "__lines", "__h1", "k", "row", "label", "score", "predicted", "n_lines", "tokens", "posterior", "rate", "copies", "copy", "lines", "at", "keep", "text_"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    docs = base.selectExpr("*", *[f"concat('{n} of ', doc_id) AS `{n}`" for n in names])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF), "clash")
        assert now.columns == docs.columns and now.count()
        assert all(r[n] == f"{n} of {r.doc_id}" for r in now.collect() for n in names)
