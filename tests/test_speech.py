"""Spoken numbers against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.speech import SPOKEN, spoken_numbers


def loop(text):
    words, out, at = re.sub("[.,]", " ", text).split(), [], 0
    while at < len(words):
        width = 1 if words[at].lower() == "is" else 2 if [w.lower() for w in words[at : at + 2]] == ["i", "s"] else 0
        digits, end, tens = "", at + width, False
        while width and end < len(words) and (words[end].lower() in SPOKEN or words[end].isdigit()):
            said = words[end] if words[end].isdigit() else SPOKEN[words[end].lower()]
            replaces = tens and not words[end].isdigit() and len(said) == 1 and said != "0"
            digits = (digits[:-1] if replaces else digits) + said
            tens = not words[end].isdigit() and len(said) == 2 and said[1] == "0" and said != "10"
            end += 1
        if width and len(digits) >= (3 if words[at] == "is" else 2):
            out.append(f"IS {digits}")
            at = end
        else:
            out.append(words[at])
            at += 1
    return " ".join(out)


@pytest.mark.parametrize(
    "said, written",
    [("I S fourteen five four three", "IS 14543"), ("IS 14 5 4 3", "IS 14543"), ("is one seven eight six", "IS 1786"), ("the limit is 10 mg", "the limit is 10 mg"), ("IS twenty five", "IS 25"), ("i s", "i s"), ("", "")],
)
def test_known(spark, said, written):
    assert spark.createDataFrame([(said,)], "t string").select(spoken_numbers(F.col("t"))).first()[0] == written == loop(said)


def test_random_words_against_a_loop(spark):
    rng = random.Random(4)
    some = [*SPOKEN, "IS", "is", "I", "S", "i", "s", "Is", "14", "5", "and", "x.", "One,", "ISO"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spoken_numbers(F.col("t")).alias("w")).collect()
    assert all(r.w == loop(texts[r.i]) for r in got)


def test_turns_of_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("text", spoken_numbers(F.col("text")).alias("w"))
    assert all(r.w == (None if r.text is None else loop(r.text)) for r in turns.collect())
