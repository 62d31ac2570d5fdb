"""Clause trees over the documents' lines, laid out on pages by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import chunking as ch
from quarry.operators import clauses as cs
from quarry.operators import structure as sr
from quarry.operators.lines import clause_paths
from quarry.plans.core import query
from quarry.tables import sorted_join, written

PAGE = 8  # lines a page


def draws(documents: DataFrame) -> DataFrame:
    """(doc, at, line, draw, tops): a document's lines with a hash each, and the sections that were begun up to it."""
    lines = documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    draw = F.crc32(F.concat_ws(":", F.col("doc").cast("string"), F.col("at").cast("string")).cast("binary"))
    begun = F.count_if(F.col("draw") % 16 < 3).over(Window.partitionBy("doc").orderBy("at"))
    return lines.withColumn("draw", draw).withColumn("tops", begun)


def outlined(documents: DataFrame) -> DataFrame:
    """Lines of text with numbers by draw: sections, clauses of two and three levels, annexes and lettered numbers."""
    drawn, draw, top = draws(documents), F.col("draw"), F.col("tops").cast("string")
    sub = lambda n: (F.shiftright(draw, 8) % n + 1).cast("string")
    text = (
        F.when(draw % 16 < 3, F.concat_ws(" ", F.concat(top, F.when(draw % 2 == 0, ".").otherwise("")), "line"))
        .when(draw % 16 < 6, F.concat_ws(" ", F.concat_ws(".", top, sub(3)), "line"))
        .when(draw % 16 == 6, F.concat_ws(" ", F.concat_ws(".", top, sub(3), sub(2)), "line"))
        .when(draw % 16 == 7, F.concat_ws(" ", sub(90), F.lower("line")))
        .when(draw % 16 == 8, F.concat_ws(" ", F.lit("ANNEX"), F.substring(F.lit("ABCDEFGH"), (F.shiftright(draw, 8) % 8 + 1).cast("int"), F.lit(1))))
        .when(draw % 16 == 9, F.concat_ws(" ", F.concat(F.lit("B-"), sub(2)), "line"))
        .otherwise(F.col("line"))
    )
    return drawn.select(
        "doc", F.col("at").alias("ord"), (F.floor(F.col("at") / PAGE) + 1).cast("int").alias("page"), text.alias("text"), F.lit(10.0).alias("size"),
        (draw % 5 == 0).alias("bold"), F.lit(56.0).alias("x0"), F.lit(None).cast("array<array<string>>").alias("rows"),
    )


def laid_out(documents: DataFrame) -> DataFrame:
    """outlined() with what printed pages add: numbers on lines of their own, unfinished lines, captions, tables, margin
    notes, list items, large headings and blank lines."""
    plain = outlined(documents)
    draw = F.crc32(F.concat_ws("/", F.col("doc").cast("string"), F.col("ord").cast("string")).cast("binary"))
    lone = F.regexp_extract("text", r"^(\d+\.?) ", 1)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    one = lambda text, x0="x0", rows=None: F.struct(
        text.alias("text"), F.when(draw % 11 == 0, 12.0).otherwise(F.col("size")).alias("size"), "bold", (F.col(x0) if isinstance(x0, str) else F.lit(x0)).alias("x0"),
        (F.lit(None) if rows is None else rows).cast("array<array<string>>").alias("rows"),
    )
    cells = F.array(F.slice(words, 1, 2), F.slice(words, 3, 3))
    shapes = (
        F.when((lone != "") & (draw % 4 == 0), F.array(one(lone), one(F.regexp_replace("text", r"^\d+\.? ", ""))))
        .when(draw % 16 == 1, F.array(one(F.concat_ws(" ", "text", F.lit("as given in clause"))), one((draw % 9 + 1).cast("string"))))
        .when(draw % 16 == 2, F.array(one(F.concat_ws(" ", F.lit("Table"), (draw % 7 + 1).cast("string"), F.slice(words, 1, 4).getItem(0))), one(F.col("text")), one(F.lit(""), rows=cells)))
        .when(draw % 16 == 3, F.array(one(F.lit(""), rows=cells), one(F.col("text"))))
        .when(draw % 16 == 5, F.array(one(F.array_join(F.slice(words, 1, 2), " "), 20.0), one(F.col("text"))))
        .when(draw % 16 == 7, F.array(one(F.concat(F.lit("a) "), "text")), one(F.lit("")), one(F.col("text"))))
        .when(draw % 16 == 8, F.array(one((draw % 5 + 1).cast("string")), one((draw % 3 + 1).cast("string")), one(F.col("text"))))
        .when(draw % 16 == 9, F.array(one(F.concat_ws(" ", F.lit("Application to"), F.concat((draw % 8 + 1).cast("string"), F.lit(".")), "text"), 20.0)))
        .when(draw % 16 == 10, F.array(one(F.concat_ws(" ", F.array_join(F.slice(words, 1, 3), " "), F.lit("—"), "text"))))
        .when(draw % 64 == 11, F.array(one(F.lit("FOREWORD"))))
        .when(draw % 64 == 12, F.array(one(F.lit("Annexure - iv (a) of the scheme"))))
        .when(draw % 64 == 13, F.array(one(F.lit("AMENDMENT NO. 2 MARKING AND PACKING"))))
        .otherwise(F.array(one(F.col("text"))))
    )
    return plain.select("doc", "ord", "page", F.posexplode(shapes).alias("nth", "it")).select("doc", (F.col("ord") * 4 + F.col("nth")).alias("ord"), "page", "it.*")


_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id || ':' || pos, ''), lambda x: ascii(x)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"
)
_FOLDED = rf"""WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split),
drawn AS (SELECT *, {_CRC} AS draw FROM raw),
begun AS (SELECT *, count(*) FILTER (draw % 16 < 3) OVER (PARTITION BY doc_id ORDER BY pos) AS tops, (draw >> 8) AS d FROM drawn),
texts AS (SELECT doc_id AS doc, pos, pos // {PAGE} + 1 AS page, draw % 5 = 0 AS bold, trim(CASE WHEN draw % 16 < 3 THEN tops || CASE WHEN draw % 2 = 0 THEN '.' ELSE '' END || ' ' || line
  WHEN draw % 16 < 6 THEN tops || '.' || (d % 3 + 1) || ' ' || line WHEN draw % 16 = 6 THEN tops || '.' || (d % 3 + 1) || '.' || (d % 2 + 1) || ' ' || line
  WHEN draw % 16 = 7 THEN (d % 90 + 1) || ' ' || lower(line) WHEN draw % 16 = 8 THEN 'ANNEX ' || substr('ABCDEFGH', (d % 8 + 1)::INT, 1)
  WHEN draw % 16 = 9 THEN 'B-' || (d % 2 + 1) || ' ' || line ELSE line END) AS text FROM begun),
roles AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc) AS n,
  CASE WHEN regexp_matches(text, '^(?i)(ANNEX\s+[A-Z]\b.*|FOREWORD|INTRODUCTION|CONTENTS|AMENDMENT\s+NO.*)$') AND (bold OR text = upper(text)) THEN 'top'
    WHEN regexp_matches(text, '^(\d{{1,2}}(\.\d{{1,3}}){{0,5}}\.?(\s|\(|$)|[A-H]-\d)') AND regexp_matches(text, '^\S+\s') THEN 'number' ELSE 'text' END AS role,
  regexp_extract(text, '^([A-H]-)?\d+(\.\d+)*') AS num, regexp_matches(text, '^[\d.]+\.\s') AS dotted, trim(regexp_replace(text, '^\S+', '')) AS rest FROM texts WHERE text <> ''),
facts AS (SELECT *, regexp_extract(num, '^(.*)\.\d+$', 1) AS above, regexp_matches(num, '^\d+$') AS plain,
  rest = '' OR regexp_matches(rest, '^[A-Z("''“‘]') AS capital, regexp_matches(rest, '^(mg|ml|g|kg|mm|cm|m|l|percent|per)\b') AS unit,
  bold OR length(regexp_replace(rest, '[^\p{{Lu}}]', '', 'g')) > 0.8 * length(regexp_replace(rest, '[^\p{{L}}]', '', 'g')) AS strong FROM roles),
steps AS (
  SELECT DISTINCT doc, 0::BIGINT AS i, {{'last': 0, 'top': []::BIGINT[], 'line': []::BIGINT[], 'open': [{{'num': '', 'line': []::BIGINT[]}}][:0], 'count': 0::BIGINT, 'why': '', 'opens': false}} AS p FROM facts
  UNION ALL
  SELECT doc, i, CASE WHEN role = 'top' THEN {{'last': p.last, 'top': [p.count], 'line': [p.count], 'open': p.open[:0], 'count': p.count + 1, 'why': '', 'opens': true}}
    WHEN role = 'number' AND why = '' THEN {{'last': CASE WHEN plain THEN num::INT ELSE p.last END, 'top': CASE WHEN plain THEN [p.count] ELSE p.top END, 'line': lineage,
      'open': list_append(list_filter(p.open, lambda o: o.num <> num), {{'num': num, 'line': lineage}}), 'count': p.count + 1, 'why': '', 'opens': true}}
    WHEN opens THEN {{'last': p.last, 'top': p.top, 'line': [p.count], 'open': p.open, 'count': p.count + 1, 'why': why, 'opens': true}}
    ELSE {{'last': p.last, 'top': p.top, 'line': p.line, 'open': p.open, 'count': p.count, 'why': why, 'opens': false}} END AS p
  FROM (SELECT *, role = 'top' OR (role = 'number' AND why = '') OR p.count = 0 AS opens,
      list_append(CASE WHEN plain THEN []::BIGINT[] WHEN held IS NOT NULL THEN held ELSE p.top END, p.count) AS lineage
    FROM (SELECT *, CASE WHEN role <> 'number' THEN '' WHEN NOT capital AND held IS NULL THEN 'lower case' WHEN NOT capital AND unit THEN 'unit'
        WHEN NOT plain AND num SIMILAR TO '[A-H].*' THEN '' WHEN NOT plain THEN CASE WHEN held IS NOT NULL OR string_split(num, '.')[1] = p.last::VARCHAR THEN '' ELSE 'no parent' END
        WHEN num::INT NOT BETWEEN 1 AND 60 THEN 'range' WHEN num::INT > p.last AND (strong AND num::INT <= p.last + 5 OR num::INT <= p.last + 3 AND (dotted OR rest <> '')) THEN ''
        WHEN num::INT > p.last AND num::INT <= p.last + 3 THEN 'bare' ELSE 'jump' END AS why
      FROM (SELECT f.*, steps.p, list_filter(steps.p.open, lambda o: o.num = f.above AND f.above <> '')[1].line AS held
        FROM steps JOIN facts f ON f.doc = steps.doc AND f.i = steps.i + 1)))),
given AS (SELECT f.*, s.p.why AS why, s.p.opens AS opens, s.p.line AS lineage FROM facts f JOIN steps s ON s.doc = f.doc AND s.i = f.i)"""


@query(f"""{_FOLDED}
SELECT doc AS doc_id, pos AS ord, num AS number, why = '' AS accepted, why AS reason, lineage[len(lineage)]::INT AS clause FROM given WHERE role = 'number'""")
def accepted_numbers(t):
    given = cs.given_clauses(cs.line_roles(outlined(t("documents")))).where("role = 'number'")
    return given.select(F.col("doc").alias("doc_id"), "ord", "number", F.col("refused").isNull().alias("accepted"), F.coalesce("refused", F.lit("")).alias("reason"), "clause")


@query(f"""{_FOLDED},
heads AS (SELECT doc, lineage[len(lineage)] AS clause, lineage, page AS page_start, CASE WHEN role = 'number' AND why = '' THEN num WHEN role = 'top' THEN 'Annex ' || text[7] ELSE 'Front' END AS number FROM given WHERE opens),
ends AS (SELECT doc, unnest(lineage) AS clause, page FROM given WHERE role = 'text' OR why <> '')
SELECT h.doc AS doc_id, h.clause::INT AS clause, number, CASE WHEN nth > 1 THEN number || ' (' || nth || ')' ELSE number END AS unique_number, len(lineage)::INT AS level,
  lineage[len(lineage) - 1]::INT AS parent, page_start::INT AS page_start, greatest(page_start, coalesce(page_end, 0))::INT AS page_end
FROM (SELECT *, row_number() OVER (PARTITION BY doc, number ORDER BY clause) AS nth FROM heads) h
LEFT JOIN (SELECT doc, clause, max(page) AS page_end FROM ends GROUP BY ALL) e ON e.doc = h.doc AND e.clause = h.clause""")
def clause_outline(t):
    tree = cs.clause_tree(outlined(t("documents")))
    return tree.select(F.col("doc").alias("doc_id"), "clause", "number", "unique_number", "level", "parent", "page_start", "page_end")


def _lines(t) -> DataFrame:
    return written(laid_out(t("documents")), "laid-out")


@query()
def clause_rows(t):
    return cs.clause_tree(_lines(t)).withColumnRenamed("doc", "doc_id")


def _tree(t) -> DataFrame:
    return written(cs.clause_tree(_lines(t)).withColumnRenamed("doc", "doc_id"), "clause-tree")


@query()
def clause_chunks(t):
    return ch.clause_chunks(_tree(t), ["doc_id", "clause"])


@query()
def clause_requirements(t):
    return ch.requirements(_tree(t).withColumn("of", F.lit("standard")), ["doc_id", "clause", "number"], "text", "kind", "of")


@query()
def clause_labels(t):
    """Clause numbers under their annexes, and the path of labels down to each clause."""
    tree = _tree(t)
    label = F.when(F.col("number") == "Front", F.col("heading")).otherwise(F.trim(F.concat_ws(" ", "unique_number", "heading")))
    paths = clause_paths(tree, "doc_id", "clause", "parent", label)
    named = sr.annex_numbers(tree.select("doc_id", F.col("clause").alias("node"), "parent", "number"))
    return paths.join(sorted_join(named.select("doc_id", F.col("node").alias("clause"), "qualified")), ["doc_id", "clause"])
