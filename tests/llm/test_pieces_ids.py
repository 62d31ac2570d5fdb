"""The registered query returns the token ids themselves, and decoding them gives the texts."""

from quarry.llm import pieces

SF = "/root/testdata/sf0.001"


def test_query_returns_ids(spark):
    model = pieces.load(pieces.DEFAULT_MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pieces.op8_sentencepiece(spark, SF)
    back = {r.doc_id: r.text for r in pieces.decode_ids(got, model, ["doc_id"]).collect()}
    rows = got.collect()
    assert len(rows) == len(texts) and all(len(r.ids) == r.n_tokens for r in rows)
    assert all(back[r.doc_id] == texts[r.doc_id] for r in rows if r.round_trip) and any(r.round_trip for r in rows)
