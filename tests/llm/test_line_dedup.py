import hashlib
from collections import Counter

from quarry.llm.line_dedup import line_dedup

LONG = "This passage has certainly more than forty characters"


def brute(rows, min_chars=40, min_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blanks))
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            at = holders.get(key(x), ())
            ids = [j for j in at if j is not None]
            if len(at) < min_docs or (ids and i is not None and i == max(ids)):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_keys_edges_and_largest_holder(spark):
    rows = [(i, f"own {i}\n {LONG.upper() if i % 2 else LONG}\t\n{'x' * 39}\n\nÉ{LONG}{i % 3}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n"), (23, f"{LONG}\n{LONG}"), (None, LONG), (24, "É" * 40), (25, "é" * 40)]
    frame = spark.createDataFrame([(i, t, "a", 5) for i, t in rows], "doc_id long, text string, n_lines string, other int")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(frame).collect())
    assert got == brute(rows)


def test_repeated_ids_are_one_document(spark):
    rows = [(1, LONG), (1, LONG + "\nb"), (1, LONG + "\nc"), (1, LONG + "\nd"), (2, LONG + "\ne"), (1, LONG)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup(frame).collect()} == {(1, 0), (2, 0)}  # two documents hold it
    more = rows + [(i, LONG) for i in (3, 4, 5, 5)]
    got = line_dedup(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute(more)


def test_repeated_ids_equal_the_sql(spark):
    import duckdb

    from quarry.llm.line_dedup import OP4_SQL

    rows = [(1, LONG), (1, LONG + "\nb"), (1, LONG), (2, "x\n" + LONG), (3, LONG), (4, LONG.upper()), (5, None), (6, LONG + " \n" + LONG)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] != 1] + [(1, LONG)])
    want = Counter((r[0], r[1], r[2]) for r in con.sql(OP4_SQL).fetchall())
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter({(r.doc_id, r.n_lines, r.n_dropped) for r in got if r.text != "b"}) == want


def test_empty_table_and_very_long_text(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long_ = "\n".join(f"{i} {LONG}" for i in range(20_000))
    rows = [(i, long_) for i in range(5)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(i, 20_000) for i in range(4)] + [(4, 0)]
    assert hashlib.sha256(max(got).text.encode()).digest() == hashlib.sha256(long_.encode()).digest()
