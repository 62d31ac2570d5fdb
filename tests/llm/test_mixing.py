import numpy as np
import pytest

from quarry.llm import mixing

SF = "/root/testdata/sf0.001"


def fitted(p, t, goal, rounds):
    """Dense projected gradient on the same objective."""
    r = np.ones(len(t))
    start = (p * t[:, None]).sum(0)
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (((p * (t * r)[:, None]).sum(0) - goal) / start))
    return r


def test_rates_meet_targets_and_equal_a_dense_solution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, domains, *_, met = mixing.mixing_rates(docs.select("doc_id", "text"), mixing.labelled_documents(spark, SF), ["doc_id"])
    assert met
    rows = out.collect()
    p, t = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows], float)
    r = np.array([x.rate for x in rows])
    assert domains == ["de", "en", "es", "fr"] and np.allclose(p.sum(1), 1)
    goal = np.array(list(mixing.tempered(dict(zip(domains, (p * t[:, None]).sum(0)))).values()))
    got = (p * (t * r)[:, None]).sum(0)
    assert np.allclose(got, goal, rtol=5e-3)
    assert min(np.abs(fitted(p, t, goal, n) - r).max() for n in range(60)) < 1e-6
    assert {x.copies - np.floor(x.rate) for x in rows} <= {0, 1} and r.min() > 0.99
    lang = {x.doc_id: x.lang for x in docs.collect()}
    right = np.mean([domains[int(np.argmax(x.posterior))] == lang[x.doc_id] for x in rows])
    assert right > 0.9  # some 80 labelled texts to learn from


def test_projection_keeps_rates_above_zero(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    goal = {"en": 1000.0, "fr": 50_000.0, "de": 0.0, "es": 0.0}
    with pytest.warns(UserWarning):  # no rate but 0 for all takes a language away that texts share
        out, domains, aim, reached, steps, _ = mixing.mixing_rates(docs, mixing.labelled_documents(spark, SF), ["doc_id"], goal)
    rows = out.collect()
    assert aim == goal and steps > mixing.WRITE  # beyond a written rate
    assert all(reached[d] == pytest.approx(sum(r.rate * r.tokens * r.posterior[i] for r in rows), rel=1e-6, abs=1e-3) for i, d in enumerate(domains))
    assert min(r.rate for r in rows) == 0.0 and any(r.copies == 0 for r in rows)
    total = {d: sum(r.rate * r.tokens * r.posterior[i] for r in rows) for i, d in enumerate(domains)}
    assert total["fr"] == pytest.approx(50_000, rel=0.05)


def test_nulls_repeats_clashes_and_nothing_to_learn(spark):
    rows = [(1, None, "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    out, domains, *_ = mixing.mixing_rates(docs, none, ["doc_id", "rate"])
    assert domains == [] and sorted(r.tokens for r in out.collect()) == [0, 0, 2, 2] and {r.copies for r in out.collect()} == {1}
    some = spark.createDataFrame([(1, "a b c", "u"), (2, "x y z", "v"), (3, None, "v"), (4, "q", None)], "doc_id long, text string, lang string")
    out, domains, *_ = mixing.mixing_rates(docs, some, ["doc_id", "rate"])
    got = out.collect()
    assert domains == ["u", "v"] and len(got) == 4 and len({(r.rate, r.copies) for r in got if r.tokens == 2}) == 1
    assert mixing.mixing_rates(docs.limit(0), some, ["doc_id"])[0].count() == 0


def test_query_shrinks_large_domains_and_keeps_the_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out, domains, aim, reached, _, met = mixing.mixing_rates(docs, mixing.labelled_documents(spark, SF), ["doc_id"], mixing.levelled)
    rows = out.collect()
    assert met and min(r.rate for r in rows) < 0.95 < 1.05 < max(r.rate for r in rows)
    assert sum(reached.values()) == pytest.approx(sum(r.tokens for r in rows), rel=5e-3)
    p, t = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows], float)
    r = np.array([x.rate for x in rows])
    assert min(np.abs(fitted(p, t, np.array(list(aim.values())), n) - r).max() for n in range(60)) < 1e-6


def test_rare_domains_share_the_rest_and_targets_must_fit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOMAINS", 2)
    some = spark.createDataFrame(
        [(i, text, lang) for i, (text, lang) in enumerate([("a b c", "u")] * 4 + [("x y z", "v")] * 3 + [("k l m", "w"), ("n o p", "q")])],
        "doc_id long, text string, lang string",
    )
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, "x y z x y"), (3, "k l m k l m"), (4, "n o p n o p")], "doc_id long, text string")
    out, domains, *_ = mixing.mixing_rates(docs, some, ["doc_id"])
    assert domains == ["u", "v", mixing.REST]
    best = {r.doc_id: domains[int(np.argmax(r.posterior))] for r in out.collect()}
    assert best == {1: "u", 2: "v", 3: mixing.REST, 4: mixing.REST}
    for goal in ({"u": 1.0}, {"u": 1.0, "v": 1.0, mixing.REST: 1.0, "w": 1.0}):
        with pytest.raises(ValueError):
            mixing.mixing_rates(docs, some, ["doc_id"], goal)


def test_a_fit_that_is_not_met_says_so(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    with pytest.warns(UserWarning, match="after 1 steps"):
        found = mixing.mixing_rates(docs, mixing.labelled_documents(spark, SF), ["doc_id"], mixing.levelled)
    assert not found.met and any(abs(found.totals[d] - found.targets[d]) > 1 for d in found.domains)


def test_a_very_long_text_is_counted_whole(spark):
    some = spark.createDataFrame([(1, "a b c", "u"), (2, "x y z", "v")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "a b " * 300_000), (2, "x")], "doc_id long, text string")
    assert sorted(r.tokens for r in mixing.mixing_rates(docs, some, ["doc_id"]).rows.collect()) == [1, 600_000]
