"""Clause trees from positioned lines.

Everything that a line says by itself, or beside its neighbours, is column work: orphan numbers join their lines by a
closed form over runs, and patterns say what a line may open. What depends on the clauses before it, whether a number is
accepted and under which clause it falls, is a fold over a document's lines: Spark deals the lines by document and sorts
them, and the task carries the open numbers from one Arrow batch to the next. Headings, kinds, paragraphs and last pages
are columns again, over the clause that each line was given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarry.functions.cleaning import join_wrapped, kind_for_heading, rows_to_markdown
from quarry.operators.lines import numbered_again
from quarry.tables import sorted_join, written

# What opens a clause, and the limits of a number's place.
TOP = r"(?i)^(FOREWORD|INTRODUCTION|ANNEX\s+[A-Z]\b.*|ANNEXURE\s*[-–]?\s*[IVXLC\d]+\b.*|AMENDMENT\s+NO\.?\s*\d+.*|CONTENTS)$"
ANNEX = r"(?i)^ANNEX\s+([A-Z])\b\s*(.*)$"
ANNEXURE = r"(?i)^ANNEXURE\s*[-–]?\s*([IVXLC\d]+)\b\s*(\([A-Z]\))?\s*(.*)$"
AMENDMENT = r"(?i)^AMENDMENT\s+NO\.?\s*(\d+)\s*(.*)$"
MARGIN_NOTE = r"^([A-Z][A-Za-z/&' ]{2,30}?)\s+(\d{1,2}\.\s+\S.*)$"
NUMBERED = r"^(\d{1,2}(?:\.\d{1,3}){0,5})(\.)?(?:\s+|(?=\())(.*)$"
LETTERED = r"^([A-H]-\d{1,2}(?:\.\d{1,3}){0,4})()\s+(.*)$"
CAPTION = r"^Table\s+([A-Z]?-?\d+[A-Z]?)\b\s*(.*)$"
IN_TEXT = r"\b(shall|given in|of Table)\b"
LIST_ITEM = r"^(?:[a-z]\)|\([a-z0-9ivx]{1,4}\)|[ivx]{1,4}\)|•|–|-\s)"
HEAD_DASH = r"^([A-Za-z][^.]{0,60}?)\s*\.?\s*[-–—:]\s+(\S.*)$"
LONE_NUMBER, LONE_TOP = r"^\d{1,2}(\.\d{1,3})*\.?$", r"^\d{1,2}\.?$"
UNFINISHED = r"(?i)\b(clause|clauses|table|annex|see|in|of|and|to|sub-clause)$"
CAPITAL_START, UNIT_START = r"^[A-Z(\"'“‘]", r"^(mg|ml|g|kg|mm|cm|m|l|percent|per)\b"
SENTENCE, HEAD_SENTENCE = r"\b(shall|should|may|must|will|is|are|has|have)\b", r"\b(shall|should|may|is|are)\b"
LARGER, NOTE_CHARS, HEADING_CHARS, HEAD_CHARS, CAPTION_CHARS = 0.5, 40, 80, 60, 120
MOST_TOP, STEP, STRONG_STEP = 60, 3, 5
LEFT_OF_MARGIN, NUMBER_LEFT, NUMBER_RIGHT = 15, 30, 60


def mostly_capitals(text: Column) -> Column:
    """Over four fifths of the letters, one at least, are capitals."""
    letters, capitals = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return (letters > 0) & (capitals > 0.8 * letters)


def titled(text: Column) -> Column:
    """Every run of letters with its first letter as capital and the rest in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def page_styles(lines: DataFrame) -> DataFrame:
    """(doc, body, margin): the font size of most characters and the rounded left edge of most lines, smaller ones first
    among equals; 10 and 0 for documents of tables only."""
    plain = F.col("rows").isNull()
    size = lines.where(plain).groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    edge = lines.where(plain).groupBy("doc", F.bround("x0").alias("x")).agg(F.count("*").alias("n"))
    size = size.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    edge = edge.groupBy("doc").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("margin"))
    both = lines.select("doc").distinct().join(sorted_join(size), "doc", "left").join(sorted_join(edge), "doc", "left")
    return both.select("doc", F.coalesce("body", F.lit(10.0)).alias("body"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


def joined_orphans(lines: DataFrame) -> DataFrame:
    """lines (doc, ord, page, text, size, bold, x0, rows) in which numbers that stand alone have met their lines.

    A number after a line that ends unfinished ("as prescribed in clause") is that line's end. A top-level number before
    a text on the same page begins that text, unless it was joined itself: in a run of lone numbers every second one is,
    counted from the last line whose own case is settled.
    """
    by = Window.partitionBy("doc").orderBy("ord")
    before = lambda c: F.lag(c).over(by)
    table = F.col("rows").isNotNull()
    last = before("text")
    ends = F.col("text").rlike(LONE_NUMBER) & ~before(table) & ~last.rlike(r"[.:;)\]]$") & last.rlike(UNFINISHED)
    begins = before(~table & F.col("text").rlike(LONE_TOP)) & ~table & (F.col("page") == before("page"))
    marked = lines.withColumns({"__ends": F.coalesce(ends, F.lit(False)), "__begins": F.coalesce(begins, F.lit(False)), "__n": F.row_number().over(by)})
    settled = F.when(F.col("__ends") | ~F.col("__begins"), F.struct("__n", F.col("__ends").cast("int").alias("joined")))
    anchor = F.last(settled, ignorenulls=True).over(by)
    marked = marked.withColumn("__joined", (F.col("__n") - anchor["__n"] + anchor["joined"]) % 2 == 1)
    unit = F.sum(F.when(F.col("__joined"), 0).otherwise(1)).over(by)
    marked = marked.withColumns({"__unit": unit, "__led": F.lead(F.col("__joined") & ~F.col("__ends")).over(by)})
    piece = F.when(F.col("__led"), F.concat(F.regexp_replace("text", r"\.+$", ""), F.lit("."))).otherwise(F.col("text"))
    # A text that a number leads also lends it its size and weight; a number that ends a line doesn't.
    lent = lambda c: F.when(~F.col("__ends"), F.col(c))
    first = lambda c: F.min_by(c, "ord").alias(c)
    parts = F.array_sort(F.collect_list(F.struct(F.col("ord"), piece.alias("text"))))
    return marked.groupBy("doc", "__unit").agg(
        F.min("ord").alias("ord"), first("page"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        F.max(lent("size")).alias("lent_size"), F.bool_or(lent("bold")).alias("lent_bold"), first("size"), first("bold"), first("x0"), first("rows"),
    ).select("doc", "ord", "page", "text", F.coalesce("lent_size", "size").alias("size"), F.coalesce("lent_bold", "bold").alias("bold"), "x0", "rows")


def line_roles(lines: DataFrame) -> DataFrame:
    """lines with what each may open, its role: table, note, top, caption, number or text; blank lines go.

    number, dotted, rest, level-independent facts of a numbered line; note, the margin note before a number on its line.
    """
    styled = joined_orphans(lines).join(sorted_join(page_styles(lines)), "doc")
    first = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord")) == 1
    styled = styled.withColumns({"text": F.trim("text"), "__first": first})
    left = (F.col("margin") != 0) & (F.col("x0") < F.col("margin") - LEFT_OF_MARGIN) & F.col("rows").isNull()
    noted = left & F.col("text").rlike(MARGIN_NOTE)
    styled = styled.withColumns(
        {
            "note": F.when(noted, F.regexp_extract("text", MARGIN_NOTE, 1)),
            "text": F.when(noted, F.regexp_extract("text", MARGIN_NOTE, 2)).otherwise(F.col("text")),
            "x0": F.when(noted, F.col("margin")).otherwise(F.col("x0")),
            "__left": left & ~noted,
        }
    )
    text = F.col("text")
    large = F.col("bold") | (F.col("size") > F.col("body") + LARGER)
    numbered, lettered = text.rlike(NUMBERED), text.rlike(LETTERED)
    placed = (F.col("x0") > F.col("margin") - NUMBER_LEFT) & (F.col("x0") < F.col("margin") + NUMBER_RIGHT)
    part = lambda i: F.when(numbered, F.regexp_extract(text, NUMBERED, i)).otherwise(F.regexp_extract(text, LETTERED, i))
    role = (
        F.when(F.col("rows").isNotNull(), "table")
        .when(text == "", None)
        .when(F.col("__left") & (F.length(text) < NOTE_CHARS) & ~numbered, "note")
        .when(text.rlike(TOP) & (large | mostly_capitals(text)) & (~F.upper(text).startswith("ANNEXURE") | F.col("__first")), "top")
        .when(text.rlike(CAPTION) & (F.col("bold") | (F.length(text) < CAPTION_CHARS)) & ~text.rlike(IN_TEXT), "caption")
        .when((numbered | lettered) & placed, "number")
        .otherwise("text")
    )
    number = F.col("role") == "number"
    read = (
        styled.withColumns({"role": role, "large": large}).where("role is not null")
        .withColumns({"number": F.when(number, part(1)), "dotted": F.when(number, part(2) != ""), "rest": F.when(number, F.trim(part(3)))})
    )
    bare = F.col("rest")
    return read.withColumns(
        {"capital": (bare == "") | bare.rlike(CAPITAL_START), "unit": bare.rlike(UNIT_START), "strong": F.when(number, F.col("large") | mostly_capitals(bare))}
    ).drop("__first", "__left", "body", "margin")


@dataclass
class Outline:
    """What a document's lines have opened so far: the numbers that later ones may continue, by place and lineage."""

    opened: int = 0
    current: int | None = None
    current_role: str = ""
    last_top: int = 0
    top: tuple[int, ...] = ()
    lineage: tuple[int, ...] = ()
    numbers: dict[str, tuple[int, ...]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    filled: bool = False

    def opens(self, role: str, above: tuple[int, ...]) -> tuple[int, ...]:
        """The lineage of a new clause below `above`, which becomes the current one."""
        self.lineage = (*above, self.opened)
        self.current, self.current_role, self.filled = self.opened, role, False
        self.opened += 1
        return self.lineage

    def outside_tables(self) -> tuple[int, ...]:
        """The lineage above which a table is put: the current clause, or what a current table stands in."""
        return self.lineage[:-1] if self.current_role == "table" else self.lineage

    def taken(self) -> list[str]:
        notes, self.notes = self.notes, []
        return notes


def refusal(number: str, dotted: bool, rest: str, capital: bool, unit: bool, strong: bool, last_top: int, numbers) -> str | None:
    """Why a number opens no clause after the numbers so far; None where it does."""
    above, _, _ = number.rpartition(".")
    if not capital and above not in numbers:
        return "lower case"
    if not capital and unit:
        return "unit"
    if not number[0].isdigit():
        return None
    if above:
        return None if above in numbers or number.split(".")[0] == str(last_top) else "no parent"
    ahead = int(number) - last_top
    if not 0 < int(number) <= MOST_TOP:
        return "range"
    if strong and 0 < ahead <= STRONG_STEP or 0 < ahead <= STEP and (dotted or rest):
        return None
    return "jump" if not 0 < ahead <= STEP else "bare"


def _number(outline: Outline, line: dict) -> tuple:
    number = line["number"]
    if number.isdigit():
        outline.last_top = int(number)
        outline.top = lineage = outline.opens("number", ())
    else:
        lineage = outline.opens("number", outline.numbers.get(number.rpartition(".")[0], outline.top))
    outline.numbers[number] = lineage
    return lineage, outline.taken(), None


def _top(outline: Outline, line: dict) -> tuple:
    outline.notes, outline.numbers = [], {}
    if line["text"].upper().startswith("ANNEXURE"):
        outline.last_top = 0
    outline.top = outline.opens("top", ())
    return outline.top, [], None


def _caption(outline: Outline, line: dict) -> tuple:
    return outline.opens("table", outline.outside_tables()), [], None


def _table(outline: Outline, line: dict) -> tuple:
    if outline.current_role == "table" and not outline.filled:
        outline.filled = True
        return None, [], "rows"
    lineage = outline.opens("table", outline.top if outline.current is None or outline.current_role == "table" else outline.lineage)
    outline.filled = True
    return lineage, [], "rows"


def _text(outline: Outline, line: dict) -> tuple:
    lineage = outline.opens("front", ()) if outline.current is None else None
    return lineage, outline.taken(), "text"


_STEPS = {"number": _number, "top": _top, "caption": _caption, "table": _table, "text": _text}
_READ = ["role", "text", "note", "number", "dotted", "rest", "capital", "unit", "strong"]
_MADE = "clause int, lineage array<int>, notes array<string>, part string, refused string"


def given_clauses(roles: DataFrame) -> DataFrame:
    """line_roles() with the clause of each line, the lineage of clauses that it opens, and the margin notes it takes.

    part says what the line adds to its clause: text, rows, or nothing; refused, why a number opened none. The fold reads
    a document's lines in order; from one batch to the next it carries the numbers of the open section.
    """
    schema = StructType([*roles.schema.fields, *StructType.fromDDL(_MADE).fields])
    names = roles.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, doc, outline = to_arrow_schema(schema), object(), Outline()
        for batch in batches:
            docs = batch.column(names.index("doc")).to_pylist()
            read = zip(*[batch.column(names.index(c)).to_pylist() for c in _READ], strict=True)
            made = []
            for key, values in zip(docs, read, strict=True):
                if key != doc:
                    doc, outline = key, Outline()
                line, why = dict(zip(_READ, values, strict=True)), None
                if line["note"] is not None:
                    outline.notes.append(line["note"])
                if line["role"] == "note":
                    outline.notes.append(line["text"])
                    made.append((None, None, None, None, None))
                    continue
                if line["role"] == "number":
                    why = refusal(*[line[c] for c in _READ[3:]], outline.last_top, outline.numbers)
                lineage, notes, part = (_text if why else _STEPS[line["role"]])(outline, line)
                made.append((outline.current, lineage and list(lineage), notes, part, why))
            columns = [pa.array(list(c), arrow.field(len(names) + i).type) for i, c in enumerate(zip(*made, strict=True))] if made else [pa.array([], f.type) for f in list(arrow)[len(names) :]]
            old = [batch.column(i).cast(arrow.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*old, *columns], schema=arrow)

    return roles.repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, schema)


def _opened_heading(rest: Column, large: Column) -> Column:
    """struct(heading, body) of what follows an accepted number."""
    capitals = mostly_capitals(rest)
    whole = (F.length(rest) <= HEADING_CHARS) & ~rest.rlike(r"[.:;]$") & ~rest.startswith("(") & ~rest.rlike(SENTENCE) & (large | capitals)
    head, body = F.regexp_extract(rest, HEAD_DASH, 1), F.regexp_extract(rest, HEAD_DASH, 2)
    dashed = rest.rlike(HEAD_DASH) & (F.length(head) <= HEAD_CHARS) & ~head.rlike(HEAD_SENTENCE)
    named = F.when(capitals & (F.length(rest) > 3), titled(rest)).otherwise(rest)
    return F.struct(
        F.when(whole, named).when(dashed, F.trim(head)).otherwise("").alias("heading"),
        F.when(whole, "").when(dashed, F.trim(body)).otherwise(rest).alias("body"),
    )


def _top_heading(text: Column) -> Column:
    """struct(number, heading) of an unnumbered heading."""
    get = lambda p, i: F.regexp_extract(text, p, i)
    suffix = F.when(get(ANNEXURE, 2) != "", F.concat(F.lit(" "), F.upper(get(ANNEXURE, 2)))).otherwise("")
    amended = F.when((get(AMENDMENT, 2) == F.upper(get(AMENDMENT, 2))) & get(AMENDMENT, 2).rlike(r"\p{Lu}"), titled(get(AMENDMENT, 2))).otherwise(F.trim(get(AMENDMENT, 2)))
    of = lambda number, heading: F.struct(number.alias("number"), heading.alias("heading"))
    return (
        F.when(text.rlike(ANNEX), of(F.concat(F.lit("Annex "), F.upper(get(ANNEX, 1))), F.trim(get(ANNEX, 2))))
        .when(text.rlike(ANNEXURE), of(F.concat(F.lit("Annexure-"), F.upper(get(ANNEXURE, 1)), suffix), F.trim(get(ANNEXURE, 3), F.lit(" -–:"))))
        .when(text.rlike(AMENDMENT), of(F.concat(F.lit("Amendment No. "), get(AMENDMENT, 1)), amended))
        .otherwise(of(titled(text), F.lit("")))
    )


def clause_tree(lines: DataFrame) -> DataFrame:
    """The clauses of positioned lines: (doc, clause, number, unique_number, heading, level, kind, parent, lineage,
    page_start, page_end, text, rows).

    lines: doc, ord, page, text, size, bold, x0, and rows (array of rows of cells) for a table, null for a line of text.
    clause counts a document's clauses from 0 and parent names one; page_end follows the text of a clause and of all
    below it. Null texts are empty lines, null styles 0 and false; documents without a line have no clause.
    """
    clean = lines.select(
        "doc", "ord", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("size", F.lit(0.0)).alias("size"),
        F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("x0", F.lit(0.0)).alias("x0"), "rows",
    )
    given = written(given_clauses(line_roles(clean)).where("clause is not null"), "clause-lines")
    opens = F.col("lineage").isNotNull()
    split = _opened_heading(F.col("rest"), F.col("large"))
    given = given.withColumn("__split", F.when(opens & (F.col("role") == "number") & F.col("refused").isNull(), split))
    notes = F.array_join("notes", " ")
    numbered = F.col("__split").isNotNull()
    heading = (
        F.when(numbered, F.when(F.col("__split.heading") == "", notes).otherwise(F.col("__split.heading")))
        .when(F.col("role") == "top", _top_heading(F.col("text"))["heading"])
        .when(F.col("role") == "caption", F.trim(F.regexp_extract("text", CAPTION, 2), F.lit(" -–—")))
        .when(F.col("role") == "table", "").otherwise("Front matter")
    )
    number = (
        F.when(numbered, F.col("number"))
        .when(F.col("role") == "top", _top_heading(F.col("text"))["number"])
        .when(F.col("role") == "caption", F.concat(F.lit("Table "), F.regexp_extract("text", CAPTION, 1)))
        .when(F.col("role") == "table", F.concat(F.lit("Table (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise("Front")
    )
    heads = given.where(opens).select("doc", "clause", "lineage", "role", "rest", F.col("text").alias("line"), F.col("page").alias("page_start"), numbered.alias("numbered"), number.alias("number"), heading.alias("heading"))
    bare = F.col("numbered") & (F.size("lineage") == 1) & (F.col("heading") == "")
    said = F.upper(F.when(F.col("role") == "top", F.col("line")).when(bare, F.col("rest")).otherwise(F.col("heading")))
    own = F.when(F.col("role").isin("caption", "table"), "table").when(F.col("numbered") | (F.col("role") == "top"), kind_for_heading(F.col("said"))).otherwise("front")
    heads = heads.withColumn("said", said).select("doc", "clause", "number", "heading", own.alias("own"), "lineage", "page_start")
    heads = written(numbered_again(heads, "doc", "number", "clause"), "clause-heads")

    # A clause has the kind of its first ancestor that says one; tables are tables.
    above = heads.where("own <> 'table'").select("doc", "clause", F.posexplode("lineage").alias("far", "at"))
    kinds = above.join(sorted_join(heads.select("doc", F.col("clause").alias("at"), F.col("own").alias("its"))), ["doc", "at"])
    kinds = kinds.groupBy("doc", "clause").agg(F.min_by("its", F.when(~F.col("its").isin("table", "other", "front"), F.col("far"))).alias("kind"))

    # Text of a caption before its table gives way to the table.
    filled = given.where("part = 'rows'").groupBy("doc", "clause").agg(F.max("ord").alias("table_ord"), F.max_by("rows", "ord").alias("rows"), F.max("page").alias("table_page"))
    body = F.when(numbered & (F.col("__split.body") != ""), F.array(F.struct(F.lit("head").alias("how"), F.col("__split.body").alias("piece"))))
    lead = F.when((F.size("notes") > 0), F.array(F.struct(F.lit("note").alias("how"), F.concat(F.lit("["), notes, F.lit("]")).alias("piece"))))
    none = F.array().cast("array<struct<how:string,piece:string>>")
    plain = F.concat(F.coalesce(lead, none), F.array(F.struct(F.lit("text").alias("how"), F.col("text").alias("piece"))))
    pieces = given.select("doc", "clause", "ord", "page", F.posexplode(F.when(F.col("part") == "text", plain).otherwise(F.coalesce(body, none))).alias("nth", "it"))
    pieces = pieces.join(sorted_join(filled.select("doc", "clause", "table_ord")), ["doc", "clause"], "left").where("table_ord is null or ord > table_ord")
    by = Window.partitionBy("doc", "clause").orderBy("ord", "nth")
    breaks = (F.col("it.how") == "text") & (F.col("it.piece").rlike(LIST_ITEM) | F.lag("it.piece").over(by).rlike(r"[.:;]$"))
    paragraph = F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(by)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "nth", "piece"))), lambda x: x["piece"])
    paragraphs = pieces.select("doc", "clause", "ord", "nth", paragraph.alias("para"), F.col("it.piece").alias("piece"))
    paragraphs = paragraphs.groupBy("doc", "clause", "para").agg(join_wrapped(in_order).alias("text"))
    texts = paragraphs.groupBy("doc", "clause").agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("all"))
    texts = texts.select("doc", "clause", F.array_join(F.transform(F.filter("all", lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n").alias("told"))

    ends = given.where("part = 'text'").groupBy("doc", "clause").agg(F.max("page").alias("end"))
    ends = heads.select("doc", "clause", "lineage").join(sorted_join(ends), ["doc", "clause"]).select("doc", F.explode("lineage").alias("clause"), "end")
    ends = ends.groupBy("doc", "clause").agg(F.max("end").alias("end"))

    keys = ["doc", "clause"]
    out = heads
    for part in (kinds, filled, texts, ends):
        out = out.join(sorted_join(part), keys, "left")
    told = F.array_join(F.array_compact(F.array(F.when(F.col("rows").isNotNull(), rows_to_markdown(F.col("rows"))), F.col("told"))), "\n\n")
    return out.select(
        *keys, "number", "heading", F.size("lineage").alias("level"), F.coalesce("kind", "own").alias("kind"),
        F.get("lineage", F.size("lineage") - 2).alias("parent"), "lineage", "page_start",
        F.greatest("page_start", F.coalesce("table_page", "page_start"), F.coalesce("end", "page_start")).alias("page_end"), told.alias("text"), "rows", "unique_number",
    )
