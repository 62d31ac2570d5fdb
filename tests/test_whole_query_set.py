"""The retrieval plans over every row whose id is divisible by 100, against brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest

from quarry.operators import retrieval
from quarry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.vec_id: (r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def nearest(rows, k=40, keep=lambda label: True):
    """qid to the k best (vec_id, score)."""
    out = {}
    for q in (q for q in rows if q % 100 == 0):
        scores = [(v, sum(a * b for a, b in zip(x, rows[q][1]))) for v, (label, x) in rows.items() if keep(label)]
        out[q] = sorted(scores, key=lambda p: (-round(p[1], 9), p[0]))[:k]
    assert len(out) > 1
    return out


def lists(found, order):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.qid, r[order])):
        out[r.qid].append(r.vec_id)
    return dict(out)


def test_cosine(spark, rows):
    want = {q: [v for v, _ in best] for q, best in nearest(rows).items()}
    assert lists(QUERIES["cosine_top40_whole"](spark, SF).collect(), "rank") == want
    want = {(q, v) for q, best in nearest(rows, 10, lambda label: label == 1).items() for v, _ in best}
    assert {(r.qid, r.vec_id) for r in QUERIES["cosine_filtered_whole"](spark, SF).collect()} == want


def test_orders_after_cosine(spark, rows):
    late, head = {}, {}
    for q, best in nearest(rows).items():
        ids = [v for v, _ in best]
        odd = [v for v in ids if rows[v][0] % 2 == 1][3:]
        late[q] = [v for v in ids if v not in odd] + odd
        head[q] = sorted(ids[:16], key=lambda v: (-(rows[v][0] + (0.4 if rows[v][0] == 3 else 0)), ids.index(v))) + ids[16:]
    assert lists(QUERIES["stray_demotion_whole"](spark, SF).collect(), "pos") == late
    assert lists(QUERIES["rerank_head_whole"](spark, SF).collect(), "pos") == head


def test_groups_and_metrics(spark, rows):
    groups, ranks = {}, []
    for q, best in nearest(rows).items():
        for place, (v, score) in enumerate(best, 1):
            top, first, n = groups.get((q, rows[v][0]), (score, place, 0))
            groups[q, rows[v][0]] = (top, first, n + 1)
        if any(v != q and label == rows[q][0] for v, (label, _) in rows.items()):
            ranks.append(min((i for i, (v, _) in enumerate(best[:10], 1) if v != q and rows[v][0] == rows[q][0]), default=99))
    got = {(r.qid, r.label): (r.best, r.first_rank, r.n) for r in QUERIES["group_best_whole"](spark, SF).collect()}
    assert got == {k: (pytest.approx(s, abs=1e-5), f, n) for k, (s, f, n) in groups.items()}
    (m,) = QUERIES["ranking_metrics_whole"](spark, SF).collect()
    assert m.n == len(ranks)
    share = lambda k: sum(r <= k for r in ranks) / len(ranks)
    assert (m.recall_at_5, m.hit_at_1) == (pytest.approx(share(5), abs=6e-4), pytest.approx(share(1), abs=6e-4))
    assert m.mrr_at_10 == pytest.approx(sum(1 / r for r in ranks if r <= 10) / len(ranks), abs=6e-4)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def lexical(docs, columns):
    """qid to the 40 best (doc_id, score), by the formula, for every term of each hundredth document."""
    split = lambda x: [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    tf, size, df = {}, {}, Counter()
    for d, r in docs.items():
        tf[d] = Counter()
        for c, w in columns.items():
            for token in split(r[c]):
                tf[d][token] += w
        size[d] = sum(len(split(r[c])) for c in columns)
        df.update(tf[d].keys())
    mean, out = sum(size.values()) / len(size), {}
    for q in (q for q in docs if q % 100 == 0):
        scores = {}
        for term in set(split(docs[q].text)):
            idf = math.log((len(docs) - df[term] + 0.5) / (df[term] + 0.5)) if df[term] else 0
            for d in docs:
                if n := tf[d].get(term):
                    scores[d] = scores.get(d, 0) + (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d] / mean))
        out[q] = sorted(scores.items(), key=lambda p: (-round(p[1], 6), p[0]))[:40]
    assert len(out) > 1
    return out


@pytest.mark.parametrize("entries, rows_", [(1 << 21, 256), (300, 7)])
def test_lexical(spark, docs, monkeypatch, entries, rows_):
    monkeypatch.setattr(retrieval, "TERM_ENTRIES", entries)  # the queries in one block, or in several
    monkeypatch.setattr(retrieval, "SCORED_ROWS", rows_)
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in QUERIES["bm25_top40_whole"](spark, SF).collect()}
    want = {(q, i): (d, pytest.approx(s, abs=2e-6)) for q, best in lexical(docs, {"text": 1.0}).items() for i, (d, s) in enumerate(best, 1)}
    assert got == want


def test_lexical_weighted_and_diversified(spark, docs):
    best = lexical(docs, {"text": 1.0, "source": 4.0, "lang": 1.5})
    got = {(r.qid, r["rank"]): r.doc_id for r in QUERIES["bm25_weighted_columns_whole"](spark, SF).collect()}
    assert got == {(q, i): d for q, found in best.items() for i, (d, _) in enumerate(found, 1)}
    assert {r.qid for r in QUERIES["diversify"](spark, SF).collect()} == set(best)


def test_hybrid(spark, rows, docs):
    words, near, want = lexical(docs, {"text": 1.0}), nearest(rows), {}
    for q in words.keys() | near.keys():
        total = Counter()
        for found in (words.get(q, []), near.get(q, [])):
            for place, (d, _) in enumerate(found, 1):
                total[d] += 1 / (60 + place)
        own = docs[q].lang if q in docs else None
        total = {d: s + (0.02 if docs[d].lang == own else 0) for d, s in total.items() if d in docs}
        for place, d in enumerate(sorted(total, key=lambda d: (-round(total[d], 9), d))[:8], 1):
            want[q, place] = d
    assert {(r.qid, r["rank"]): r.doc_id for r in QUERIES["hybrid_retrieval_whole"](spark, SF).collect()} == want
