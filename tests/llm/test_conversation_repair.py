import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import conversation_repair as cr
from quarry.llm.conversation_repair import chained, damaged, op12_conversation_repair, repaired, solve, turn_digests

FORM = re.compile(r"(s?(ua)+)?\Z")


def cheapest(roles, faults):
    """(cost, audit, final initials) by trying every edit, with up to two inserts in every gap."""
    best = None
    for kept in itertools.product("KUAD", repeat=len(roles)):
        if any(f in "bd" and k != "D" for f, k in zip(faults, kept)):
            continue
        base = sum(2 if k == "D" else (k != "K") + 5 * (f == "t") for f, k in zip(faults, kept))
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(roles) + 1):
            final, audit = gaps[0], "I" * len(gaps[0])
            for role, k, gap in zip(roles, kept, gaps[1:]):
                final += {"K": role, "U": "u", "A": "a", "D": ""}[k] + gap
                audit += {"K": "K", "U": "R", "A": "R", "D": "D"}[k] + "I" * len(gap)
            if FORM.match(final):
                choice = (base + 5 * audit.count("I"), audit, final)
                best = min(best or choice, choice)
    return best


@pytest.mark.parametrize("size", range(5))
def test_cheapest_edits_against_every_edit(size):
    rng = random.Random(size)
    cases = {("".join(rng.choices("sua?", (1, 4, 3, 1), k=size)), "".join(rng.choices("bdt.", (1, 1, 2, 5), k=size))) for _ in range(12 if size == 4 else 40)}
    for roles, faults in cases:
        cost, edits, tail = chained([{"-": solve(roles, faults, "-")}]) if roles else chained([])
        assert (cost, ("".join(edits) + tail).translate(cr._PUBLIC)) == cheapest(roles, faults)[:2]


def test_runs_chain_to_the_same_edits():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 60)
        roles, faults = "".join(rng.choices("sua?", (1, 5, 5, 1), k=n)), "".join(rng.choices("bdt.", (1, 1, 3, 6), k=n))
        whole = chained([{"-": solve(roles, faults, "-")}])
        cut = rng.randrange(1, 9)
        parts = [{b: solve(roles[i : i + cut], faults[i : i + cut], b) for b in "-sua"} for i in range(0, n, cut)]
        got = chained(parts)
        assert (got[0], "".join(got[1]), got[2]) == (whole[0], whole[1][0], whole[2])


def plain(rows):
    """The contract's columns by a loop: rows of (conv_id, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        seen, faults = set(), ""
        for _, r, x in mine:
            solid = x.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "."
            seen.add((r, x))
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for _, r, _ in mine)
        cost, edits, tail = chained([{"-": solve(initials, faults, "-")}])
        lines, at = [], 0
        for e in "".join(edits) + tail:
            if e in "EF":
                lines.append("user:" if e == "E" else "assistant:")
                continue
            _, r, x = mine[at]
            at += 1
            if e != "D":
                lines.append({"K": r, "R": "user", "S": "assistant"}[e] + ":" + x)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        audit = ("".join(edits) + tail).translate(cr._PUBLIC)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "half", "", " \t", None, "Yes.", "É?", "a.\x0b", "two\nlines."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "", "tool", "User"]), rng.choice(texts)) for c in [None, *range(30)] for _ in range(rng.randrange(1, 9))]
    return rows + [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 40}.") for t in range(300)] + [(51, 0, "user", "x" * 300_000 + ".")]


@pytest.mark.parametrize("run", [3, 1024])
def test_odd_conversations_against_a_loop(spark, run):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, at int").repartition(5)
    fixed = repaired(frame, run=run)
    shas = {r.conv_id: r.repaired_sha256 for r in turn_digests(fixed.turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas.get(r.conv_id, none)) for r in fixed.conversations.collect()}
    assert got == plain(rows)
    turns = fixed.turns.where("conv_id = 50").orderBy("position").collect()
    assert FORM.match("".join(t.role[0] for t in turns)) and len({t.position for t in turns}) == len(turns)


def test_an_empty_table(spark):
    fixed = repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert fixed.conversations.count() == 0 and fixed.turns.count() == 0


def test_query_with_nulls_against_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in odd_rows() if r[0] != 51]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(cr.OP12_SQL)
    got = op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "Hi. There!") for c in (1, None) for t in [None, *range(60)]]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("role", "text")).alias("all")).collect()
    found = {(r.conv_id, r.turn): [tuple(x) for x in r["all"]] for r in got}
    text = lambda x: " " if x is None else str(x)
    for c, t, role, said in rows:
        fate = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "Hi There")], 3: [(role, said)] * 2, 4: [("user", said)]}.get(fate, [(role, said)])
        assert found.get((c, t), []) == want
