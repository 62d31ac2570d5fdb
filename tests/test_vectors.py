"""Exact vector search with cluster bounds against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as rt


def grouped(rng, n, groups, spread, unit=True):
    """Vectors around few directions."""
    centres = rng.normal(size=(groups, 16))
    rows = centres[rng.integers(groups, size=n)] / 4 + spread * rng.normal(size=(n, 16))
    return rows / np.linalg.norm(rows, axis=1)[:, None] if unit else rows * rng.uniform(0, 3, size=n)[:, None]


def best(rows, queries, k):
    out = {}
    for q, x in queries:
        scores = [(-round(float(np.dot(v, x)), 9), i) for i, v in rows]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("unit, block", [(True, 8192), (False, 8192), (True, 4)])
def test_equals_brute_force(spark, monkeypatch, unit, block):
    monkeypatch.setattr(rt, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = list(enumerate(grouped(rng, 1500, 12, 0.02, unit)))
    rows += [(2000 + i, rows[3][1]) for i in range(90)] + [(3000, np.zeros(16))]  # one vector many times, and none at all
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(9999, None)], "vec_id long, embedding array<double>").repartition(6)
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in asked] + [(7, None)], "qid long, vector array<double>")
    got = {}
    for r in rt.cosine_topk(frame, queries, 10).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == best(rows, asked, 10)


def test_far_clusters_are_not_scored(spark):
    rng = np.random.default_rng(5)
    rows = grouped(rng, 6000, 30, 0.01)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    queries = frame.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    scored = rt.cosine_scored(frame, queries, 10).agg(F.sum("scored")).first()[0]
    assert scored < 0.15 * 6000 * 60


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(5, [1.0, 0.0])], "qid long, vector array<double>")
    assert [(r.vec_id, r.score, r["rank"]) for r in rt.cosine_topk(frame, queries).orderBy("rank").collect()] == [(1, 1.0, 1), (2, 0.0, 2)]
    assert rt.cosine_topk(frame.where("vec_id < 0"), queries).count() == 0
    assert rt.cosine_topk(frame, queries.where("qid < 0")).count() == 0
