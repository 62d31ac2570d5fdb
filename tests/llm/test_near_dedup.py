import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_dedup as nd
from quarry.llm.hashing import shingles
from quarry.llm.near_dedup import dart_signatures, near_dup_classes

SF = "/root/testdata/sf0.001"


def weighted(text):
    words = [w for w in text.translate({ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """Class of each row: smallest id over links at 0.8 and equal texts."""
    sets = [weighted(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    pairs = {(i, j) for at in post.values() for i in at for j in at if i < j}
    pairs |= {(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] or "") == (rows[j][1] or "")}
    for i, j in pairs:
        if (rows[i][1] or "") == (rows[j][1] or "") or similarity(sets[i], sets[j]) >= 0.8:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for at in groups.values():
        ids = [rows[i][0] for i in at if rows[i][0] is not None]
        for i in at:
            out[i] = min(ids) if ids else None
    return Counter((rows[i][0], out[i]) for i in range(len(rows)))


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.class_id) for r in near_dup_classes(docs).collect())
    assert got == brute(rows)


def test_family_nulls_ties_and_extra_columns(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > rate else "edit%d" % rng.randrange(10**6) for w in base)) for i, rate in enumerate([0, 0.01, 0.02, 0.03, 0.05, 0.3] * 6)]
    rows += [(100, None), (101, ""), (None, ""), (102, "one two"), (103, "ONE  two"), (104, "one three"), (102, "one two"), (None, "lonely words stand here alone today")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, k int")
    got = Counter((r.doc_id, r.class_id) for r in near_dup_classes(frame).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_dup_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = random.Random(1)
    words = [f"w{rng.randrange(40)}" for _ in range(400)]
    other = words[:320] + [f"v{rng.randrange(40)}" for _ in range(80)]
    some, darts = dart_signatures([" ".join(words), " ".join(other), ""])
    assert list(some) == [True, True, False]
    want = similarity(weighted(" ".join(words)), weighted(" ".join(other)))
    assert abs((darts[0] == darts[1]).mean() - want) < 0.12


@pytest.mark.parametrize("text", ["", "a", "a b c d e f", "x " * 30, "é è\tü\nß a b"])
def test_shingle_counts(text):
    owner, cell = shingles(["a b", text, "q"])
    assert (owner == 1).sum() == sum(weighted(text).values())
    assert len(np.unique(cell[owner == 1])) == (owner == 1).sum()


def test_darts_of_real_weights():
    rng = np.random.default_rng(3)
    codes = rng.integers(1, 2**63, 60).astype(np.uint64)
    for scale in (0.01, 1.0, 37.5):  # the cost follows the darts, not the weights
        a, b = rng.gamma(1.0, scale, 60) + 1e-6, rng.gamma(1.0, scale, 60) + 1e-6
        b[:40] = a[:40] * rng.uniform(0.8, 1.2, 40)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        k = 4096
        darts = nd.throw(np.repeat([0, 1], 60), np.tile(codes, 2), np.concatenate([a, b]), 2, k)
        assert abs((darts[0] == darts[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / k)


def test_bins_bound_the_similarity():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(5, 300))) for _ in range(30)]
    sets = [weighted(t) for t in texts]
    bins = [np.frombuffer(b, np.uint16).astype(int) for b in nd.bin_counts(texts)]
    for i in range(30):
        for j in range(i):
            shared = np.minimum(bins[i], bins[j]).sum()
            assert shared / (bins[i].sum() + bins[j].sum() - shared) >= similarity(sets[i], sets[j]) - 1e-12


def test_buckets_of_unlike_members_in_small_blocks(spark, monkeypatch):
    """Chains that no hub covers, in buckets cut into blocks; hubs with more pairs than a group takes."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "PAIRS", 2)
    rng = random.Random(5)
    rows, at = [], 0
    for base in range(4):
        words = [f"w{base}x{i}" for i in range(150)]
        for step in range(9):
            rows.append((at, " ".join(words)))
            at += 1
            for _ in range(2):
                words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in near_dup_classes(frame).collect()) == brute(rows)


def test_kept_rows_with_nulls_ties_empty_table_and_extra_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base, 1), (3, base, 1), (2, base + " end", 2), (None, base, 9), (None, "alone here", 8), (5, None, 7), (4, "", 6), (3, "other text of the same id", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = Counter(tuple(r) for r in nd.near_dedup(frame).collect())
    assert got == Counter([(2, base + " end", 2), (None, "alone here", 8), (4, "", 6), (3, "other text of the same id", 5)])
    assert nd.near_dedup(frame.limit(0)).count() == 0 and nd.near_dedup(frame).columns == frame.columns


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-900])), (3, " ".join(words[:60_000]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dup_classes(frame).collect()} == {(1, 1), (2, 1), (3, 3)}
