"""Structure of documents: line filters, metadata, headings, annex numbers, terms, amendments, slugs, catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.cleaning import devanagari_ratio, is_broken_devanagari, looks_like_legacy_font, strip_parallel_devanagari
from quarry.tables import sorted_join, written

# Words of a sentence, and months of an amendment's date.
SENTENCE = r"\b(shall|should|may|must|will|is|are|has|have)\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def unreadable(line: Column) -> Column:
    """Lines that the English text leaves out: mostly another script, a legacy font, or broken letters."""
    return (devanagari_ratio(line) > 0.3) | looks_like_legacy_font(line) | is_broken_devanagari(line)


def garbled_pages(lines: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, garbled): whether more than half of a page's lines of over twelve characters can't be read."""
    bad = looks_like_legacy_font(F.col(text)) | is_broken_devanagari(F.col(text))
    counts = lines.where(F.length(text) > 12).groupBy(doc, page).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    every = lines.select(doc, page).distinct().join(counts, [doc, page], "left")
    return every.select(doc, page, F.coalesce(F.col("bad") > 0.5 * F.col("n"), F.lit(False)).alias("garbled"))


def metadata(lines: DataFrame, number: Column, doc: str = "doc_id", first: int = 15, near: float = 0.5) -> DataFrame:
    """(doc, number, title) from a document's first page (lines: doc, line_no, size, text): the first number among its
    first lines, and its largest lines that hold none."""
    marked = lines.withColumn("__number", number)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("line_no"))
    biggest = F.max("size").over(Window.partitionBy(doc))
    marked = marked.withColumns({"__n": place, "__big": F.col("size") >= biggest - near})
    title = F.sort_array(F.collect_list(F.when(F.col("__big") & F.col("__number").isNull(), F.struct("line_no", "text"))))
    return marked.groupBy(doc).agg(
        F.min_by("__number", F.when(F.col("__number").isNotNull() & (F.col("__n") <= first), F.col("line_no"))).alias("number"),
        F.left(F.array_join(F.transform(title, lambda x: x["text"]), " "), F.lit(300)).alias("title"),
    )


def left_margin(lines: DataFrame, doc: str = "doc_id", x: str = "x0") -> DataFrame:
    """(doc, margin): the rounded left edge of most lines; the smallest among equals."""
    counts = lines.groupBy(doc, F.bround(x).alias("margin")).agg(F.count("*").alias("n"))
    return counts.groupBy(doc).agg(F.max_by("margin", F.struct("n", -F.col("margin"))).alias("margin"))


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def split_heading(rest: Column, bold: Column) -> Column:
    """struct(heading, body) of what follows a clause number: a short line in bold or capitals is a heading, as is what
    stands before a dash, unless it reads like a sentence."""
    capitals = (rest == F.upper(rest)) & rest.rlike("[A-Z]")
    short = (F.length(rest) <= 80) & ~rest.rlike(r"[.:;]$") & ~rest.startswith("(") & ~rest.rlike(SENTENCE)
    whole = short & (bold | capitals)
    head = F.trim(F.regexp_extract(rest, r"^([^—–]{2,60}?)\s+[—–-]\s+(\S.*)$", 1))
    dashed = (head != "") & ~head.rlike(SENTENCE)
    body = F.regexp_extract(rest, r"^([^—–]{2,60}?)\s+[—–-]\s+(\S.*)$", 2)
    named = F.when(capitals & (F.length(rest) > 3), title_case(rest)).otherwise(rest)
    return F.struct(
        F.when(rest == "", "").when(whole, named).when(dashed, head).otherwise("").alias("heading"),
        F.when((rest == "") | whole, "").when(dashed, body).otherwise(rest).alias("body"),
    )


def annex_numbers(clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """clauses (doc, node, parent, number) with qualified: a plain number below an annex gets the nearest annex's letter
    ("B-3.1"). Ancestors are climbed by doubling, so deep trees take few joins; clauses that are their own ancestors, which
    no number of rounds would settle, raise ValueError."""
    letter = F.regexp_extract("number", r"^Annex ([A-Z])", 1)
    own = clauses.select(doc, "node", F.col("parent").alias("__up"), F.nullif(letter, F.lit("")).alias("__own"))
    # __found: the nearest annex among the ancestors seen so far; __up: the next ancestor to ask.
    state = written(own.select(doc, "node", "__up", F.lit(None).cast("string").alias("__found"), "__own"), "annexes")
    most, reach = state.count(), 1
    while state.where("__up is not null and __found is null").limit(1).count():
        if reach > 2 * most:
            raise ValueError("clauses that are their own ancestors")
        reach *= 2
        above = state.select(doc, F.col("node").alias("__up"), F.col("__up").alias("__next"), F.coalesce("__own", "__found").alias("__seen"))
        state = written(
            state.join(sorted_join(above), [doc, "__up"], "left").select(
                doc, "node", F.when(F.coalesce("__found", "__seen").isNull(), F.col("__next")).alias("__up"), F.coalesce("__found", "__seen").alias("__found"), "__own"
            ),
            "annexes",
        )
    named = clauses.join(sorted_join(state.select(doc, "node", "__found")), [doc, "node"], "left")
    plain = F.col("number").rlike(r"^\d+(\.\d+)*$") & F.col("__found").isNotNull()
    return named.withColumn("qualified", F.when(plain, F.concat("__found", F.lit("-"), "number")).otherwise(F.col("number"))).drop("__found")


def manual_number(number: Column) -> Column:
    """A plain number as a manual's own section."""
    return F.when(number.rlike(r"^\d+(\.\d+)*$"), F.concat(F.lit("§"), number)).otherwise(number)


def embed_text(number: Column, title: Column, path: Column, text: Column) -> Column:
    """What is embedded for a chunk: its document, its place and its text."""
    head = F.concat(F.when(F.coalesce(number, F.lit("")) != "", F.concat(number, F.lit(": "))).otherwise(""), title)
    return F.concat_ws("\n", head, path, text)


def terms(clauses: DataFrame, keep: list[str]) -> DataFrame:
    """keep, term, definition: headed sub-clauses of a terminology, and those of the form "term - definition"."""
    form = r"(?s)^([^—–:-]{2,80}?)\s*[—–:-]\s+(.+)$"
    headed = (F.coalesce("heading", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    able = clauses.where((F.col("kind") == "terminology") & (F.col("level") >= 2))
    found = able.select(
        *keep,
        F.when(headed, F.trim("heading")).otherwise(F.trim(F.regexp_extract("text", form, 1))).alias("term"),
        F.when(headed, F.trim("text")).otherwise(F.trim(F.regexp_extract("text", form, 2))).alias("definition"),
    )
    return found.where((F.col("term") != "") & (F.col("definition") != ""))


def amendments(clauses: DataFrame, keep: list[str]) -> DataFrame:
    """keep, date ("Month YYYY" or null), excerpt of every amendment at the top level."""
    date = F.regexp_extract(F.concat_ws(" ", "heading", "text"), rf"(({MONTHS})\s+\d{{4}})", 1)
    able = clauses.where((F.col("kind") == "amendment") & (F.col("level") == 1))
    return able.select(*keep, F.nullif(F.regexp_replace(date, r"\s+", " "), F.lit("")).alias("date"), F.left("text", F.lit(500)).alias("excerpt"))


def unique_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """rows with unique_slug: the first keeps its slug, the nth gets "-n"."""
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("unique_slug", F.when(nth > 1, F.concat_ws("-", slug, nth)).otherwise(F.col(slug)))


def catalogue_upsert(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(base, status, source, products, added): standards (base, status, source) after list rows (base, status, source,
    product, seq): the last row's status and source win, products are added once in order, unknown bases are new."""
    first = rows.where(F.col("product").isNotNull()).groupBy("base", "product").agg(F.min("seq").alias("seq"))
    listed = first.groupBy("base").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "product"))), lambda x: x["product"]).alias("products"))
    last = rows.groupBy("base").agg(F.max_by("status", "seq").alias("__status"), F.max_by("source", "seq").alias("__source"), F.lit(True).alias("__row"))
    out = known.withColumn("__known", F.lit(True)).join(last, "base", "full").join(listed, "base", "left")
    given = lambda new, old: F.when(F.col("__row"), F.col(new)).otherwise(F.col(old))
    return out.select(
        "base", given("__status", "status").alias("status"), given("__source", "source").alias("source"),
        F.coalesce("products", F.array().cast("array<string>")).alias("products"), F.col("__known").isNull().alias("added"),
    )


def resolved(references: DataFrame, standards: DataFrame) -> DataFrame:
    """references (from_id, base) with to_id: the last id of the base; null where it is unknown."""
    return references.join(standards.groupBy("base").agg(F.max("id").alias("to_id")), "base", "left")


def catalogue_groups(cells: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(doc, category, number, product): rows of a list (doc, row, is_header, text, number) under the last header row
    before them, each number and product once."""
    before = Window.partitionBy(keep).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = cells.withColumn("category", F.last(F.when(F.col("is_header"), F.col("text")), ignorenulls=True).over(before))
    body = headed.where(~F.col("is_header")).select(keep, "category", "number", F.col("text").alias("product"), "row")
    return body.groupBy(keep, "category", "number", "product").agg(F.min("row").alias("row"))


def inside(outer: tuple[Column, ...], inner: tuple[Column, ...], slack: float = 1.0) -> Column:
    """Whether the middle of a box (x0, y0, x1, y1) lies in another one, give or take a little."""
    x, y = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return x.between(outer[0] - slack, outer[2] + slack) & y.between(outer[1] - slack, outer[3] + slack)


def single_script(clauses: DataFrame) -> DataFrame:
    """A clause tree (heading, text, rows) without the other script where both stand side by side: in the heading, in
    each paragraph of the text and in each cell."""
    paragraphs = F.transform(F.split("text", "\n\n"), strip_parallel_devanagari)
    cells = F.transform("rows", lambda row: F.transform(row, strip_parallel_devanagari))
    return clauses.withColumns({"heading": strip_parallel_devanagari(F.col("heading")), "text": F.array_join(paragraphs, "\n\n"), "rows": cells})
