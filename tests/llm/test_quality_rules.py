import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality_rules as quality_rules_module
from quarry.llm.quality_rules import js_distance, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 100, "é|ü <b>\n\né|ü <b>\n", " nbsp is no blank", "\x0bq\x0c"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["ab", "ab ", "", "c#"]) for _ in range(30)) for _ in range(10)]
    frame = spark.createDataFrame([(i, t, None, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    rows = quality_rules(frame).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(js_distance(F.col("p"), F.col("q")), js_distance(F.col("p"), F.col("p"))).first()
    m = (np.array(p) + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(got[0] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and got[1] == 0


def test_shouting_and_symbols_are_rejected_and_clean_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules(docs).where("not base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(poor) / len(poor) < 0.6


def test_equal_hashes_of_unlike_words_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules_module, "SPARE", 54)  # three bits of hash and less
    test_counts_against_brute_force(spark)


def test_a_very_long_text(spark):
    words = [f"w{i % 70_001}" for i in range(150_000)]
    frame = spark.createDataFrame([(1, " ".join(words), "xx")], "doc_id long, text string, lang string")
    r = quality_rules(frame).first()
    assert (r.n_words, r.n_repeat_words) == (150_000, base(" ".join(words))[4])


def test_every_language_that_occurs_has_a_reference(spark):
    rng = random.Random(8)
    alphabets = {"ru": "абвгдежз", "ja": "あいうえおかき", "en": "abcdefgh"}
    def prose(lang):
        vocabulary = [lang[0] + "".join(rng.choice(alphabets[lang]) for _ in range(3)) for _ in range(40)]
        return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    makers = {lang: prose(lang) for lang in alphabets}
    rows = [(i, makers[lang](120), lang) for i, lang in enumerate(["ru", "ja", "en"] * 15)]
    rows += [(100, makers["ja"](120), "ru"), (101, makers["ru"](120), None), (102, "ONE " * 5 + "?!? " * 90, "en")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(45) if not got[i].base_failed) and sum(got[i].base_failed for i in range(45)) < 5
    assert got[100].word_distance > 0.4 and not got[100].kept
    assert got[101].char_distance is None and got[101].kept == (not got[101].base_failed)


def test_without_references_only_base_rules_decide(spark):
    rows = [(1, "word " * 10, "xx"), (2, " ".join(map(str, range(99))), None)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [False, True] and got[1].char_distance is None
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
