import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.exact_dedup import PerfectHash, _words, exact_dedup


def keys(n, salt=""):
    return _words(np.frombuffer(b"".join(hashlib.sha256(f"{salt}{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32))


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_slots_are_minimal_and_perfect(n):
    made = PerfectHash.over(keys(n))
    again = PerfectHash(made.sizes, made.packed())
    assert sorted(again.slots(keys(n))) == list(range(n))
    strangers = again.slots(keys(500, "x"))
    assert strangers.min(initial=0) >= -1 and strangers.max(initial=-1) < n
    assert len(made.packed()) <= 1 + n  # under eight bits a key


def brute(rows):
    text = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(text(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            out[i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


ROWS = [(i, f"text {i % 23}" + " \t\n"[i % 3] * (1 + i % 2) + "end") for i in range(300)]
ROWS += [(1000, None), (1001, ""), (1002, " "), (1003, "\t\n"), (1004, "\x85"), (1005, "\xa0"), (7, "a b"), (7, "a  b"), (7, "a b"), (None, "a\nb"), (None, "only null"), (None, "only null"), (1006, "x" * 2_000_000)]
ROWS += [(5000 - i, "hot") for i in range(400)]


@pytest.mark.parametrize("earlier", ["doc_id % 2 = 0", "doc_id < 150", "true", "false", "text like 'h%' and doc_id < 4800"])
def test_any_history_gives_the_same_rows(spark, earlier):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    assert found(exact_dedup(frame, F.expr(earlier), shard=4)) == brute(ROWS)


def test_clashing_columns_pass_through(spark):
    names = ["row", "digest", "at", "earlier", "winner", "copies", "shard", "held", "fresh", "keep_id", "kept"]
    made = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ROWS[:60]]
    frame = spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = exact_dedup(frame, F.col("doc_id") < 30)
    assert found(got) == brute(ROWS[:60])
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names if n not in ("keep_id", "kept"))
    assert {r.doc_id: r.text for r in got.collect()} == dict(ROWS[:60])


def test_text_ids_and_an_empty_table(spark):
    frame = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(frame, F.lit(False)).collect()} == {("a", "a", True), ("b", "a", False), (None, "a", False)}
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0
