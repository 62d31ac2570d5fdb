"""BM25 of many queries: what meets densely, what leaves a task, and blocks, strips and floors of any size."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import retrieval


def plain(docs, queries, k=40):
    """{(qid, rank): (doc_id, score)} by the formula; docs and queries: id to words."""
    tf, df = {d: Counter(words) for d, words in docs.items()}, Counter(w for words in docs.values() for w in set(words))
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    for q, terms in queries.items():
        scores = Counter()
        for term in set(terms):
            idf = math.log((len(docs) - df[term] + 0.5) / (df[term] + 0.5))
            for d in docs:
                if n := tf[d][term]:
                    scores[d] += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        best = sorted(((d, s) for d, s in scores.items()), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out |= {(q, i): (d, pytest.approx(s, abs=2e-6)) for i, (d, s) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def words():
    """300 documents of words of very different frequency; the second half repeats the first."""
    rng = np.random.default_rng(5)
    made = [[f"w{int(x)}" for x in rng.zipf(1.3, int(n)) if x < 5000] for n in rng.integers(1, 60, 150)]
    return dict(enumerate(made + made))


def test_frequent_terms_do_not_meet_their_queries_one_by_one(monkeypatch):
    made = Counter()

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def repeat(self, *args):
            out = np.repeat(*args)
            made["rows"] += len(out)
            return out

    rng = np.random.default_rng(3)
    terms = np.sort(rng.choice(1 << 40, 300, replace=False))
    block = retrieval.TermBlock([terms] * 1000, [np.linspace(0.1, 2, 300)] * 1000)
    monkeypatch.setattr(retrieval, "np", Counted())
    got = block.scores([(np.repeat(np.arange(60), 300), np.tile(terms, 60), 1.0)], 60, 300.0)
    assert made["rows"] < 1_000_000  # of 18 million products
    assert np.allclose(got, np.linspace(0.1, 2, 300).sum(), rtol=1e-12, atol=0)


@pytest.mark.parametrize("share, strip, products", [(0, 3, 50), (1 / 256, 2048, 1 << 20), (2, 7, 1), (1 / 20, 1, 1 << 20)])
def test_dense_and_other_terms_give_the_same_sums(monkeypatch, words, share, strip, products):
    for name, value in (("DENSE_SHARE", share), ("STRIP", strip), ("PRODUCTS", products)):
        monkeypatch.setattr(retrieval, name, value)
    weight = {w: math.log(1 + 300 / n) for w, n in Counter(w for x in words.values() for w in set(x)).items()}
    code = {w: i * 7919 for i, w in enumerate(sorted(weight))}
    asked = [sorted(set(words[d]), key=code.get) for d in range(0, 150, 10)]
    block = retrieval.TermBlock([np.array([code[w] for w in x]) for x in asked], [np.array([weight[w] for w in x]) for x in asked])
    some = [words[d] for d in range(40)]
    columns = [(np.repeat(np.arange(40), [len(x) for x in some]), np.array([code[w] for x in some for w in x]), 1.0)]
    got = block.scores(columns, 40, 30.0)
    want = np.zeros((40, 15))
    for i, x in enumerate(some):
        for j, q in enumerate(asked):
            want[i, j] = sum(weight[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / 30)) for w, n in Counter(x).items() if w in q)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("candidates", [1, 3, 100])
def test_rows_below_the_floor_do_not_leave_a_task(monkeypatch, candidates):
    monkeypatch.setattr(retrieval, "CANDIDATES", candidates)
    best = retrieval.Best(2, 2, [("id", pa.int64())], np.array([5.0, -np.inf]))
    near = np.array([[4.0, 0.0], [5.0, 1e-6], [6.0, 2.0], [5.0, 3.0]])
    for first in (0, 2):
        part = near[first : first + 2]
        best.add(0, part, lambda row, of, part=part: part[row, of], [pa.array([7, 9, 1, 3]).slice(first, 2)])
    assert [(r["query"], r["id"]) for r in best.kept().to_pylist()] == [(0, 1), (0, 3), (1, 3), (1, 1)]
    assert best.floors.tolist() == [5.0, 2.0]


@pytest.mark.parametrize("entries, few, few_rows", [(1 << 21, 2, 20), (150, 8, 1 << 14), (1, 300, 1)])
def test_floors_of_some_documents_change_nothing(spark, monkeypatch, words, entries, few, few_rows):
    words = {d: x if d < 150 else [f"v{d}", *x] for d, x in words.items()}
    for name, value in (("TERM_ENTRIES", entries), ("FLOOR_ROWS", 0), ("FEW", few), ("FEW_ROWS", few_rows)):
        monkeypatch.setattr(retrieval, name, value)
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in words.items()], "doc_id long, text string")
    queries = {d: words[d] for d in range(0, 300, 60)}
    asked = spark.createDataFrame(list(queries.items()), "qid long, terms array<string>")
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(docs, asked, {"text": 1.0}, k=7).collect()}
    assert got == plain(words, queries, 7)


def test_ids_of_any_kind_and_texts_without_words(spark):
    rows = [("b", "red red"), ("a", "red red"), (None, "red red"), ("c", ""), ("d", None), ("e", "blue sky"), ("f", "grey"), ("g", "grey")]
    docs = spark.createDataFrame(rows, "name string, text string")
    asked = spark.createDataFrame([(None, ["red"]), (3, ["none"]), (4, ["sky", "red"])], "qid long, terms array<string>")
    got = [(r.qid, r["rank"], r.name) for r in retrieval.bm25(docs, asked, {"text": 1.0}, k=3, id_col="name").collect()]
    assert sorted(got, key=str) == sorted([(None, 1, None), (None, 2, "a"), (None, 3, "b"), (4, 1, "e"), (4, 2, None), (4, 3, "a")], key=str)
    assert retrieval.bm25(docs.limit(0), asked, {"text": 1.0}, id_col="name").collect() == []


def test_copies_are_scored_once(spark, monkeypatch, words):
    """Documents that are half copies, and queries of the same terms: each met once, and every id in its place."""
    made, asked_for = {}, []
    write, block = retrieval.written, retrieval.TermBlock

    def kept(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(retrieval, "written", kept)
    monkeypatch.setattr(retrieval, "TermBlock", lambda hashes, weights: asked_for.append(len(hashes)) or block(hashes, weights))
    few = {d: words[d % 30] for d in range(240)}
    few[239] = few[238] = few[237] = ["alone", *few[237]]
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in few.items()], "doc_id long, text string")
    queries = {d: few[d] for d in (0, 30, 60, 5, 239)} | {999: few[0][::-1]}
    asked = spark.createDataFrame(list(queries.items()), "qid long, terms array<string>")
    for floor_rows in (1 << 16, 0):
        monkeypatch.setattr(retrieval, "FLOOR_ROWS", floor_rows)
        found = retrieval.bm25(docs, asked, {"text": 1.0}, k=11).collect()
        assert {(r.qid, r["rank"]): (r.doc_id, r.score) for r in found} == plain(few, queries, 11)
        assert made["distinct-tokens"].count() == len({tuple(sorted(x)) for x in few.values()})
    assert asked_for == [3, 3]
