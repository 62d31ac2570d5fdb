"""Every registered query against its DuckDB counterpart, and the rest against brute force or known answers."""

import math
import random
import sqlite3
from collections import Counter, deque

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, retrieval
from quarry.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from quarry.sources.pages import page_clauses

SF, ORACLE_SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ORACLE_SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, ORACLE_SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(want.columns, want.fetchall())
    assert found


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_limiter_against_a_loop(spark):
    from quarry.streaming.limits import admit

    assert admit([0.0, 60.0, 60.5], 1, 60.0)[0] == [True, False, True]  # one exactly a window old still counts
    events = spark.read.parquet(f"{SF}/events.parquet")
    held, want = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        d = held.setdefault(r.user_id, deque())
        t = r.ts.timestamp()
        while d and d[0] < t - 6 * 3600:
            d.popleft()
        want[r.event_id] = len(d) < 3
        if want[r.event_id]:
            d.append(t)
    assert {r.event_id: r.allowed for r in QUERIES["sliding_limiter"](spark, SF).collect()} == want


def test_ttl_against_a_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    filled, want = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        t = r.ts.timestamp()
        want[r.event_id] = r.user_id in filled and t - filled[r.user_id] < 12 * 3600
        if not want[r.event_id]:
            filled[r.user_id] = t
    assert {r.event_id: r.hit for r in QUERIES["ttl_cache"](spark, SF).collect()} == want


def test_diversify_takes_caps_and_budget(spark):
    rows_ = [(0, p, p, g, c, lst, n) for p, (g, c, lst, n) in enumerate(
        [("a", 1, False, 3000), ("a", 2, False, 10), ("a", 2, False, 10), ("b", 3, False, 10), ("a", 4, True, 10), ("a", 4, True, 10), ("a", 4, True, 10), ("a", 4, True, 10), ("b", 5, False, 9000)], 1)]
    frame = spark.createDataFrame(rows_, "qid int, pos int, id int, grp string, clause int, is_list boolean, n_words int")
    got = [r.id for r in retrieval.diversified(frame).orderBy("cid").collect()]
    assert got == [1]  # the first is always taken and uses up the budget
    assert [(r.cid, r.id) for r in retrieval.diversified(frame.where("pos > 1"), per_group=1, k=3).orderBy("cid").collect()] == [(1, 2), (2, 4), (3, 5)]
    small = frame.where("pos > 1")
    assert [r.id for r in retrieval.diversified(small, per_clause=1).orderBy("cid").collect()] == [2, 4, 5, 6, 7]


def packs(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in frame.select("i", chunking.packed(F.trim("t")).alias("p")).orderBy("i").collect()]


def cost(text):
    return int(len(text.split()) * 1.3) + 1


def test_packing_rules(spark):
    text = "\n\n".join(f"Sentence number {i} has a handful of words in it." for i in range(200))
    long_ = "start.\n\n" + " ".join(["word"] * 1000) + "\n\nend of it"
    parts, cut, *rest = packs(spark, [text, long_, "", " a "])
    assert len(parts) > 1 and all(cost(p) <= 470 for p in parts)
    assert all(f"number {i} " in " ".join(parts) for i in range(200))
    assert [len(c.split()) for c in cut[1:5]] == [269, 269, 269, 193] and cut[-1].endswith("end of it") and cut[-1].startswith("start.")
    assert rest == [[], ["a"]]


def test_packing_by_its_definition(spark):
    """Every chunk is as long as the target allows and begins with the longest run of units that fits the overlap."""
    rng = random.Random(4)
    texts = ["\n\n".join(" ".join(f"u{n}x{i}" for i in range(rng.randrange(1, 90))) for n in range(60)) for _ in range(8)]
    for text, parts in zip(texts, packs(spark, texts)):
        units = text.split("\n\n")
        runs = [[units.index(u) for u in p.split("\n\n")] for p in parts]
        assert all(run == list(range(run[0], run[-1] + 1)) for run in runs) and runs[0][0] == 0 and runs[-1][-1] == 59
        for run, after in zip(runs, runs[1:]):
            new = run[-1] + 1
            assert sum(cost(units[i]) for i in run) <= 350 < sum(cost(units[i]) for i in run) + cost(units[new])
            kept = [i for i in after if i < new]
            assert sum(cost(units[i]) for i in kept) <= 52.5 and new in after
            earlier = (kept[0] if kept else new) - 1
            assert sum(cost(units[i]) for i in kept) + cost(units[earlier]) > 52.5


def test_page_clauses_of_a_known_page():
    page = "<html><head><title>t</title></head><body><nav>x</nav><main><h1>Title</h1><p>Intro.</p><h2>One</h2><ul><li>first</li></ul><p><b>Short head</b></p><p>body <b>bold</b> text</p><script>no()</script></main></body></html>"
    assert page_clauses(page) == [("front", "Title", "Intro."), ("§1", "One", "• first"), ("§2", "Short head", "body bold text")]


def test_page_blocks_rows(spark):
    found = QUERIES["page_blocks"](spark, SF).collect()
    assert found and all(r.heading or r.text for r in found)


def test_bm25_equals_full_text_search(spark):
    """Unstemmed BM25 against the closed form that SQLite's full-text index computes."""
    docs = [(i, t) for i, t in enumerate(["red red fox", "blue fox jumps", "green", "red green blue", "lazy dog sleeps", "quick fox", "dog"])]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", docs)
    want = {i: round(s, 9) for i, s in con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH 'red OR dog'")}
    queries = spark.createDataFrame([(0, ["red", "dog"])], "qid int, terms array<string>")
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), queries, {"text": 1.0})
    assert {r.doc_id: round(r.score, 9) for r in got.collect()} == want


def test_stemmed_bm25_equals_full_text_search(spark):
    docs = [(i, t) for i, t in enumerate(["Safety helmets for riders", "a helmet", "cafés and a café", "caresses of ponies", "relational hopping", "generalizations, oscillators", "nothing else"])]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize = 'porter unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", docs)
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (["helmet", "cafe"], ["caress", "pony", "relate"], ["hop", "generalize", "oscillate"], ["helmets"]):
        want = {i: round(s, 9) for i, s in con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", [" OR ".join(words)])}
        queries = spark.createDataFrame([(0, words)], "qid int, terms array<string>")
        got = retrieval.bm25(corpus, queries, {"text": 1.0}, stem=True)
        assert {r.doc_id: round(r.score, 9) for r in got.collect()} == want


def test_stems_equal_the_full_text_index():
    from quarry.functions.stemming import plain_letters, stem_word

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize = 'porter unicode61 remove_diacritics 2')")
        con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    rng = random.Random(6)
    ends = "s es ies ed ing eed ational ization iveness fulness ousli biliti logi bli al ance ement ion sion tion e ll y ative ical ness ize ator".split()
    words = {"".join(rng.choice("abcdeioulmnrstwxyz") for _ in range(rng.randrange(1, 7))) + rng.choice(["", *ends]) + rng.choice(["", "", *ends]) for _ in range(4000)}
    words |= {"hopefulness", "sky", "caress", "agreed", "conflated", "falling", "filing", "roll", "controlling", "ééé", "señor", "w" * 70 + "ing"}
    for w in words:
        con.execute("DELETE FROM f")
        con.execute("INSERT INTO f VALUES (?)", [w])
        (want,) = con.execute("SELECT term FROM v").fetchone()
        assert stem_word(plain_letters(w)) == want, w


def test_paths_of_deep_trees_and_cycles(spark):
    from quarry.operators.lines import clause_paths

    chain = [(1, i, i - 1 if i else None) for i in range(20)] + [(1, 50, 49), (2, 0, None)]
    frame = spark.createDataFrame(chain, "doc int, node int, parent int")
    got = {(r.doc, r.node): (r.level, r.path) for r in clause_paths(frame, "doc", "node", "parent", F.col("node").cast("string")).collect()}
    assert got[1, 19] == (20, " › ".join(map(str, range(20)))) and got[1, 50] == (1, "50") and got[2, 0] == (1, "0") and len(got) == 22
    with pytest.raises(ValueError):
        clause_paths(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, None)], frame.schema), "doc", "node", "parent", F.lit("x"))


def test_cosine_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = random.Random(1)
    rows_ = [(i, [rng.random(), rng.random()]) for i in range(30)]
    frame = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = retrieval.cosine_topk(frame, frame.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 3)
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1]
    want = {(q, v) for q, x in rows_ for v, _ in sorted(((v, dot(x, y)) for v, y in rows_), key=lambda p: (-round(p[1], 9), p[0]))[:3]}
    assert {(r.qid, r.vec_id) for r in got.collect()} == want


def test_sweep_counts_by_definition(spark):
    from quarry.operators.evaluation import threshold_sweep

    rng = random.Random(2)
    rows_ = [(round(rng.uniform(-9, 3), rng.choice([1, 2, 5])), rng.random() < 0.5) for _ in range(300)] + [(0.29, True), (0.57, False)]
    got = {round(r.threshold, 2): (r.refusal, r.false_refusal) for r in threshold_sweep(spark.createDataFrame(rows_, "score double, answerable boolean")).collect()}
    bad, good = [s for s, a in rows_ if not a], [s for s, a in rows_ if a]
    for t, (x, y) in got.items():
        assert x == pytest.approx(sum(s < t for s in bad) / len(bad)) and y == pytest.approx(sum(s < t for s in good) / len(good)), t


def test_rank_fusion_known_case(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid int, doc_id int, rank int")
    b = spark.createDataFrame([(0, 3, 1), (0, 1, 2)], "qid int, doc_id int, rank int")
    got = {r.doc_id: r.score for r in retrieval.rrf(a, b).collect()}
    assert got == {1: pytest.approx(1 / 61 + 1 / 62), 2: pytest.approx(1 / 62), 3: pytest.approx(1 / 63 + 1 / 61)}


def test_limiter_stream_gives_the_same(spark, tmp_path):
    from quarry.streaming.limits import limiter_stream

    events = spark.read.parquet(f"{SF}/events.parquet").limit(200).select("user_id", "event_id", "ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = limiter_stream(stream, "user_id", "ts", "event_id", 3, 6 * 3600.0)
    run = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    from quarry.streaming.limits import sliding_limiter

    batch = sliding_limiter(spark.read.parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", 3, 6 * 3600.0)
    assert Counter(tuple(r) for r in spark.table("limited").collect()) == Counter(tuple(r) for r in batch.collect())


def test_find_standards_meets_two_rows_a_question(spark):
    from quarry.operators.details import find_standards

    rng = random.Random(5)
    kinds, years = ("catalogue", "standard", None), (None, 1990, 1991, 1992)
    known = [(i, rng.choice((0, 1, 2, None)), rng.choice(kinds), rng.choice(years)) for i in range(40)]
    asked = [(q, rng.choice((0, 1, 2, 3, None)), rng.choice((*years, 2000))) for q in range(60)]
    frames = spark.createDataFrame(asked, "qid int, base int, year int"), spark.createDataFrame(known, "id int, base int, kind string, year int")
    got = {r.qid: r.id for r in find_standards(*frames).collect()}
    first = lambda year: lambda s: (year is None or s[3] != year, -1 if s[2] is None else s[2] == "catalogue", s[3] is None, -(s[3] or 0), s[0])
    for q, base, year in asked:
        own = sorted((s for s in known if base is not None and s[1] == base), key=first(year))
        assert got[q] == (own[0][0] if own else None), (q, base, year)
    # Many standards of one base: the join has a row a question, however many there are.
    seen = []
    many = spark.range(2000).selectExpr("id", "1 as base", "'standard' as kind", "cast(id % 30 as int) as year")
    out = find_standards(spark.range(500).selectExpr("id as qid", "1 as base", "cast(id % 40 as int) as year"), many)
    out.collect()

    def joins(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return joins(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return joins(node.plan())
        if "Join" in node.nodeName():
            seen.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        return [joins(children.apply(i)) for i in range(children.size())]

    joins(out._jdf.queryExecution().executedPlan())
    assert seen and max(seen) <= 500


def test_sweep_rounds_as_its_sql(spark):
    from quarry.operators.evaluation import threshold_sweep

    scores = [8.585, 16.885, 33.035, 35.855, 40.825, 0.29, -0.004]
    frame = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(scores)], "score double, answerable boolean")
    got = sorted(r.threshold for r in threshold_sweep(frame, ()).collect())
    assert got == sorted({r[0] for r in duckdb.sql(f"SELECT round_even(unnest({scores}::DOUBLE[]), 2)").fetchall()})


def test_long_numbers_stay_whole(spark):
    from quarry.functions.identifiers import all_numbers

    got = spark.createDataFrame([("IS 1000429 and IS 100042:2001",)], "t string").select(all_numbers(F.col("t"))).first()[0]
    assert got == ["IS 1000429", "IS 100042:2001"]


def test_words_end_at_other_letters_as_in_the_sql(spark, tmp_path):
    lines = ["a@b.cd übon x", "a@b.cd overon x", "a@b.cd on x", "ätest it now then some more words", "a contest of seven words and more here"]
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(0, i, "user", x) for i, x in enumerate(lines)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as con:
        for name, table in (("odd_lines", "documents"), ("follow_up_context", "conversations")):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
            assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL[name]).fetchall()), name


def test_scoring_memory_is_bounded_in_the_number_of_queries(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    terms = np.sort(rng.choice(1 << 40, 300, replace=False))
    block = retrieval.TermBlock([terms] * 1000, [rng.random(300) for _ in range(1000)])
    columns = [(np.repeat(np.arange(60), 300), np.tile(terms, 60), 1.0), (np.arange(60), terms[:60], 2.0)]
    tracemalloc.start()
    got = block.scores(columns, 60, 301.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    # Pieces of any size give the same sums.
    for products in (1, 700, 1 << 40):
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        assert np.allclose(block.scores([(d[d < 3], t[d < 3], w) for d, t, w in columns], 3, 301.0), got[:3], rtol=1e-12, atol=0)


def test_few_texts_are_python_strings_while_composed(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from quarry.functions import cleaning

    given = pa.array(["é" * 5000, None, ""] * 500)
    tracemalloc.start()
    got = cleaning._nfc.func(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == ["é" * 5000, None, ""] * 500 and peak < 5e6


def test_checks_of_one_small_file_run_in_many_tasks(spark, tmp_path):
    columns = ("id as p_partkey", "concat('part ', id) as p_name", "'TYPE A' as p_type", "'B' as p_brand", "cast(id % 50 as int) as p_size")
    spark.range(30).selectExpr(*columns).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("validated_points", "checked_summaries"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [draft") >= 2, name
