"""Quotes of every length against a plain substring search."""

import pytest

from quarry.operators import validation

TEXT = "Prefix one two three four five six seven eight nine ten eleven twelve thirteenth\nend."
TEXTS = [(1, TEXT), (2, "one  two three"), (3, "one two three four five six seven eight ninety"), (4, ""), (5, None)]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_every_length_is_found(spark, monkeypatch, broadcast):
    monkeypatch.setattr(validation, "MAX_BROADCAST_SHORT", broadcast)
    words = TEXT.split()
    asked = {" ".join(words[i : i + n]) for n in range(1, 13) for i in range(0, 13 - n)}
    # The first and the last word of a quote may be parts of the passage's words.
    asked |= {"fix one two three four five six seven eight ni", "ten eleven twelve thirteen", "fix one tw", "ne", "e t", " one two ", "one two four", "missing words of a quote"}
    quotes = [(i, q) for i, q in enumerate(sorted(asked))] + [(999, None)]
    want = {(i, d) for i, q in quotes for d, t in TEXTS if q is not None and t is not None and q in t}
    found = validation.found_quotes(
        spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(TEXTS, "doc_id int, text string"), "quote", "text", ["doc_id"]
    )
    assert {(r.item_id, r.doc_id) for r in found.collect()} == want


def test_only_short_only_long_or_none(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    for quote, ids in (("one", {1, 2, 3}), ("two three four", {1, 3}), (" ".join(TEXT.split()[1:12]), {1})):
        quotes = spark.createDataFrame([(0, quote)], "item_id int, quote string")
        assert {r.doc_id for r in validation.found_quotes(quotes, docs, "quote", "text", ["doc_id"]).collect()} == ids
    none = spark.createDataFrame([], "item_id int, quote string")
    assert validation.found_quotes(none, docs, "quote", "text", ["doc_id"]).collect() == []
