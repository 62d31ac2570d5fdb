"""Repair of conversation structure at least cost: which turns to keep, rerole or delete, and where to insert one.

A dynamic program over the retained turns: a turn is kept or reroled into a final role, the gap to the retained turn
before it costs the prefix sum of deletions and is priced through a running minimum for each role, the pair of roles says
how many turns must be inserted between them, and of equal costs the least audit wins. The program composes: for a run of
turns it gives the best edits from each role before to each role after, so a long conversation is cut into runs of
bounded length that are solved apart and then chained by their costs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WS_CLASS, table, written
from quarry.llm.ordering import numbered

#: Turns of a run.
RUN = 1024

RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Edits in ASCII order as the audit compares them; inserts and reroles stand here by role, user first.
_PUBLIC = str.maketrans("EFS", "IIR")

#: The last final role: none yet, system, user, assistant. What must be inserted before a turn's final role, None where
#: no insert helps, and before the conversation's end.
_STATES = "-sua"
_BETWEEN = {
    ("-", "s"): "", ("-", "u"): "", ("-", "a"): "E",
    ("s", "u"): "", ("s", "a"): "E",
    ("u", "u"): "F", ("u", "a"): "",
    ("a", "u"): "", ("a", "a"): "E",
}
_AT_END = {"-": "", "s": "EF", "u": "F", "a": ""}


@dataclass
class Repaired:
    """conversations: a row each with what was found, its cost and audit. turns: the repaired turns in order."""

    conversations: DataFrame
    turns: DataFrame


@lru_cache(maxsize=1 << 14)
def solve(roles: str, faults: str, start: str) -> tuple[tuple[str, int, str], ...]:
    """(last role, cost, edits) for every role that a run of turns can end in, from the role before it.

    roles has an initial a turn (s, u, a or ?), faults one of `b` blank, `d` duplicate, `t` truncated or `.`. Edits are
    D delete, E or F insert a user or an assistant, K keep, R or S rerole to user or assistant; they compare as strings.
    """
    # For each role: the least cost of ending in it less the deletions up to there, the edits, and the turns they cover.
    best: dict[str, tuple[int, str]] = {start: (0, "")}
    covered = {start: 0}
    for at, (role, fault) in enumerate(zip(roles, faults, strict=True)):
        if fault in "bd":
            continue
        deleted, extra = DELETE * at, TRUNCATED if fault == "t" else 0
        ends = {}
        for final in "sua":
            if final == role:
                edit, price = "K", extra
            elif final == "s":
                continue
            else:
                edit, price = ("R" if final == "u" else "S"), extra + RETAG
            for last, (cost, edits) in best.items():
                added = _BETWEEN.get((last, final))
                if added is None:
                    continue
                total = cost + deleted + INSERT * len(added) + price
                found = ends.get(final)
                if found is None or total <= found[0]:
                    choice = (total, edits + "D" * (at - covered[last]) + added + edit)
                    ends[final] = choice if found is None else min(found, choice)
        for final, (total, edits) in ends.items():
            choice, held = total - DELETE * (at + 1), best.get(final)
            if held is None or choice < held[0] or (choice == held[0] and edits < held[1] + "D" * (at + 1 - covered[final])):
                best[final], covered[final] = (choice, edits), at + 1
    whole = len(roles)
    return tuple((last, cost + DELETE * whole, edits + "D" * (whole - covered[last])) for last, (cost, edits) in best.items())


def chained(runs: list[dict[str, tuple]]) -> tuple[int, list[str], str]:
    """The least (cost, edits) through runs, given as {role before: solve()}: cost, edits of each run, and those at the end."""
    # Equal lengths of non-inserts make runs' edits comparable one by one, so a chain is a tuple of strings.
    held = {"-": (0, ())}
    for run in runs:
        after: dict[str, tuple] = {}
        for last, (cost, edits) in held.items():
            for final, more, text in run[last]:
                choice = (cost + more, (*edits, text))
                if final not in after or choice < after[final]:
                    after[final] = choice
        held = after
    cost, edits = min((cost + INSERT * len(_AT_END[last]), (*edits, _AT_END[last])) for last, (cost, edits) in held.items())
    return cost, list(edits[:-1]), edits[-1]


def legal_pairs(initials: str) -> int:
    """How many neighbours are not system-user, user-assistant or assistant-user."""
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _solve_runs(schema):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for number, roles, faults in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                paths = [(before, *end) for before in (_STATES if number else "-") for end in solve(roles, faults, before)]
                rows.append((number, roles[0], roles[-1], legal_pairs(roles), faults.count("b"), faults.count("d"), faults.count("t"), [dict(zip(("before", "after", "cost", "edits"), p, strict=True)) for p in paths]))
            columns = [pa.array(list(x), schema.field(i + 1).type) for i, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *columns], schema=schema)

    return run


def _chain_runs(schema):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for runs in batch.column(1).to_pylist():
                paths = [{} for _ in runs]
                for held, one in zip(paths, runs, strict=True):
                    for p in one["paths"]:
                        held.setdefault(p["before"], []).append((p["after"], p["cost"], p["edits"]))
                cost, edits, end = chained(paths)
                seams = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(runs, runs[1:], strict=False))
                total = lambda name: sum(r[name] for r in runs)  # noqa: B023, E731
                audit = ("".join(edits) + end).translate(_PUBLIC)
                rows.append((total("blank"), total("duplicate"), total("truncated"), total("illegal") + seams, cost, audit, edits, end))
            columns = [pa.array(list(x), schema.field(i + 1).type) for i, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *columns], schema=schema)

    return run


def _arrow(rows: DataFrame, columns: str):
    """The Spark and Arrow schemas of (conv, columns)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType([rows.schema["conv"], *StructType.fromDDL(columns).fields])
    return made, to_arrow_schema(made)


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN) -> Repaired:
    """The conversations of rows with their faults and the cheapest edits that give role initials `(s?(ua)+)?`.

    A conversation's rows go by turn (nulls first), equal turns by role and text. A row's first fault counts: blank (no
    character but ASCII blanks), duplicate (its role and text came before), truncated (its last such character is none
    of .!?). Keeping costs 0, reroling to user or assistant 1, deleting 2 and is forced for blank and duplicate rows,
    inserting an empty user or assistant turn 5; a truncated row that stays costs 5 more. Of equal costs the edits whose
    initials are least in ASCII win.

    conversations: id_col, gaps (turn numbers that lack between the least and the greatest), blank, duplicate,
    truncated, illegal (neighbours whose initials are not su, ua or au), cost (longs), audit. turns: id_col, position
    (long), edit (I, K or R), role, text; positions ascend.

    Defined cases: null roles and texts are one space; a null id is a conversation; null turns don't count for gaps; a
    role whose initial is none of s, u, a can only be reroled or deleted. An empty table gives empty results. Other
    columns don't take part, whatever their names. A long conversation is solved in runs of `run` turns; its audit is
    one value of the result.
    """
    named = rows.select(
        F.struct(F.col(id_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    placed = numbered(named, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "repair-turns").drop("of")
    same = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    initial = F.substring("role", 1, 1)
    turns = written(
        placed.select(
            "conv", "at", "turn", same.alias("same"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
            F.when(~F.col("text").rlike(f"[^{WS_CLASS}]"), "b").when(~F.col("text").rlike(f"[.!?][{WS_CLASS}]*\\z"), "t").otherwise(".").alias("fault"),
        ),
        "repair-marks",
    )
    # The first row of each text is met by its place, so that a text in many rows isn't a key of theirs.
    first = turns.groupBy("conv", "same").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("fresh"))
    marks = turns.join(first, ["conv", "at"], "left").withColumn("fault", F.when((F.col("fault") != "b") & F.col("fresh").isNull(), "d").otherwise(F.col("fault")))
    told = marks.groupBy("conv", F.floor(F.col("at") / run).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("all"))
    text_of = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    one = "run long, first string, last string, illegal long, blank long, duplicate long, truncated long, paths array<struct<before:string,after:string,cost:long,edits:string>>"
    made, arrow = _arrow(told, one)
    solved = told.select("conv", "run", text_of("initial").alias("roles"), text_of("fault").alias("faults")).mapInArrow(_solve_runs(arrow), made)
    gathered = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "first", "last", "illegal", "blank", "duplicate", "truncated", "paths"))).alias("runs"))
    made, arrow = _arrow(gathered, "blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<string>, tail string")
    found = written(gathered.mapInArrow(_chain_runs(arrow), made), "repair-edits")

    spans = (
        turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
        .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    )
    report = found.join(spans, "conv").select(F.col("conv.id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # A turn's edits: the inserts before it and what becomes of it.
    edits = found.select("conv", F.posexplode("edits").alias("run", "text")).select("conv", "run", F.regexp_extract_all("text", F.lit("[EF]*[DKRS]"), 0).alias("steps"))
    known = placed.withColumn("run", F.floor(F.col("at") / run).cast("int")).join(edits, ["conv", "run"])
    step = F.get("steps", (F.col("at") % run).cast("int"))
    made_turn = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    role_of = lambda mark: F.when(mark.isin("E", "R"), "user").otherwise("assistant")

    def turn(mark: Column) -> Column:
        return (
            F.when(mark == "K", made_turn(F.lit("K"), F.col("role"), F.col("text")))
            .when(mark.isin("R", "S"), made_turn(F.lit("R"), role_of(mark), F.col("text")))
            .otherwise(made_turn(F.lit("I"), role_of(mark), F.lit("")))
        )

    kept = known.select("conv", "at", "role", "text", step.alias("step")).where(F.col("step") != "D")
    changed = kept.select("conv", "at", F.posexplode(F.transform(F.split("step", ""), turn)).alias("nth", "to"))
    ends = found.where("tail <> ''").select("conv", F.lit((1 << 60) - 1).alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("tail").alias("step"))
    ends = ends.select("conv", "at", F.posexplode(F.transform(F.split("step", ""), turn)).alias("nth", "to"))
    position = (F.col("at") * 4 + F.col("nth")).alias("position")
    out = changed.unionAll(ends).select(F.col("conv.id").alias(id_col), position, "to.edit", "to.role", "to.text")
    return Repaired(report, out)


def turn_digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, repaired_sha256): SHA-256 (hex) of a conversation's `role:text`, joined by newlines, in order.

    A digest is one sequential computation, so a conversation goes through one task; Spark sorts its turns, with spill,
    and the task holds the digest's state and a batch.
    """
    schema = turns.select(id_col).schema.add("repaired_sha256", "string")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, group, state = to_arrow_schema(schema), object(), None
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), []
            for conv, line in zip(ids, batch.column(1).to_pylist(), strict=True):
                if state is None or conv != group:
                    if state is not None:
                        done.append((group, state.hexdigest()))
                    group, state = conv, hashlib.sha256()
                    state.update(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], arrow.field(0).type), pa.array([state.hexdigest()])], schema=arrow)

    lines = turns.select(id_col, F.concat("role", F.lit(":"), "text").alias("line"), "position")
    return lines.repartition(id_col).sortWithinPartitions(id_col, "position").select(id_col, "line").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its text, 2 removes
    [.!?] from it, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    cut = F.translate(text_of("text"), ".!?", "")
    return (
        rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate"))
        .where("fate <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, cut).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest repair and the repaired turns' digest."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repaired(damaged(rows))
    key = lambda df: df.withColumn("conv", F.struct("conv_id")).drop("conv_id")
    all_ids = key(rows.select("conv_id").distinct())
    out = all_ids.join(key(fixed.conversations), "conv", "left").join(key(turn_digests(fixed.turns)), "conv", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv.conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _oracle() -> str:
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||"
        " coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b),"
        " [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"
    )
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    move = lambda p, c, a, t: f"{{'c': p.{p}.c + {c}, 'a': p.{p}.a || {a}, 't': p.{p}.t || {t}}}"

    def retained(final: str, last: str) -> str:
        key, added = {"-": "n"}.get(last, last), _BETWEEN[last, final]
        if final == "s":
            return move(key, "r.extra", "'K'", "r.line")
        name, same = (user if final == "u" else assistant), f"r.initial = '{final}'"
        insert, edit = {"": "''", "E": user, "F": assistant}[added], "I" if added else ""
        return move(
            key, f"{INSERT * len(added)} + r.extra + CASE WHEN {same} THEN 0 ELSE 1 END",
            f"CASE WHEN {same} THEN '{edit}K' ELSE '{edit}R' END", f"{insert} || CASE WHEN {same} THEN r.line ELSE {name} || r.text END",
        )

    def state(final: str) -> str:
        key = {"-": "n"}.get(final, final)
        gone = move(key, "2", "'D'", "''")
        kept = ", ".join(retained(final, last) for last, to in _BETWEEN if to == final)
        if final == "-":
            return f"'n': {gone}"
        may = "r.fault NOT IN ('b', 'd')" + (" AND r.initial = 's'" if final == "s" else "")
        return f"'{key}': CASE WHEN {may} THEN list_sort([{gone}, {kept}])[1] ELSE {gone} END"

    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fate FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '?' END AS initial FROM hurt),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
rows_ AS (SELECT conv_id, i, n, initial, fault, text, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra, chr(10) || role || ':' || text AS line FROM marked),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, n, {{'n': {{'c': 0::BIGINT, 'a': '', 't': ''}}, 's': {none}, 'u': {none}, 'a': {none}}} AS p FROM rows_
  UNION ALL
  SELECT r.conv_id, r.i, r.n, {{{state('-')}, {state('s')}, {state('u')}, {state('a')}}} AS p
  FROM steps JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM steps.conv_id AND r.i = steps.i + 1),
ends AS (SELECT conv_id, list_sort([p.n, p.a, {move('u', '5', "'I'", assistant)}, {move('s', '10', "'II'", user + ' || ' + assistant)}])[1] AS e
  FROM steps WHERE i = n),
found AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _oracle()
