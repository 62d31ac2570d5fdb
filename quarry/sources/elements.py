"""Web pages as text runs with their element paths, and what the paths say: content, sections, tables, list rows.

A task parses a page once into its runs of text, each with the elements it stands in; everything after is column work on
runs, so a rule about elements is a rule about paths. Table grids are a fold over a table's sorted rows that carries the
cells which reach into later ones.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarry.functions.cleaning import normalize_text, rows_to_markdown
from quarry.functions.identifiers import all_numbers

# The content's class, what isn't content, noise lines, question numbers and columns of official lists.
AREA, DROPPED_CLASS = "who_we_area", "fbc"
DROPPED = ("script", "style", "nav", "form", "iframe", "noscript")
NOISE = r"(?i)^(Read More\s*»?|\(?\s*(size|आकार)\s*[–-].*\)?|Last Updated on .*|Skip Content|Home|/|»|Click here|पुराने दिशानिर्देश देखें)$"
QUESTION = r"^\s*(?:Q\s*\.?\s*)?(\d{1,3})(?:\s*[.):]\s*|\s+)"
UPDATED = r"Last Updated on\s+([A-Z][a-z]+ \d{1,2}, \d{4})"
HEADINGS, PARAGRAPHS = ("h1", "h2", "h3", "h4", "h5"), ("p", "li")
WALKED = ("ul", "ol", "div", "section", "span", "center", "tbody", "strong", "b", "a", "u", "em")
LIST_COLUMNS = {"number": ("is no", "आईएस"), "product": ("product category", "product", "उत्पाद"), "title": ("title",), "order": ("notification", "order", "अधिसूचना")}
SHORT_HEADING, MIN_TEXT, LOOSE_TEXT = 90, 150, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The largest spans that HTML allows, and the depth to which elements open, as in browsers.
COLUMNS_SPANNED, ROWS_SPANNED, DEPTH = 1000, 65534, 512

#: Elements that are taken whole, bold ones, those of tables, and those whose starts count: the rest is only walked.
WHOLE, BOLD, CELLS = (*HEADINGS, *PARAGRAPHS, "table"), ("strong", "b"), ("td", "th")
STARTS = frozenset((*WHOLE, *BOLD, *CELLS))
#: What normalize_text changes in a text whose blanks are single.
MARKED = r"[\x{A0}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FB00}-\x{FB04}\x{FEFF}]"
#: What a batch of runs weighs: characters, and 16 for each element of a path.
BATCH = 4 << 20

_RUN = "pos int, text string, path array<struct<node:int,tag:string,classes:array<string>,across:int,down:int>>"
_CONTENT = "pos int, text string, under array<struct<node:int,tag:string,role:string>>"


class _Runs(HTMLParser):
    """A page's runs of text in order with the open elements; an empty run marks each cell and each other element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []
        self.runs: list[tuple] = []
        self.nodes = 0

    def element(self, tag, given):
        span = lambda name, most: min(most, max(1, int(given[name]))) if given.get(name, "").strip().isdecimal() else 1
        return self.nodes, tag, given.get("class", "").split(), span("colspan", COLUMNS_SPANNED), span("rowspan", ROWS_SPANNED)

    def begun(self, element):
        self.runs.append(("", (*self.open, element)))

    def handle_starttag(self, tag, attrs):
        if len(self.open) < DEPTH:
            element = self.element(tag, {k: v or "" for k, v in attrs})
            self.begun(element)
            if tag not in VOID:
                self.open.append(element)
        self.nodes += 1

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][1] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_startendtag(self, tag, attrs):
        held = len(self.open)
        self.handle_starttag(tag, attrs)
        del self.open[held:]

    def handle_data(self, data):
        if data.strip():
            self.runs.append((data, tuple(self.open)))

    def found(self):
        return self.runs


class _Content(_Runs):
    """The runs of a page's content with the elements below its root. An element is (node, tag, role, depth, the innermost
    element around it that isn't content, the areas around it, whether it is shown); its role is null where it isn't
    taken whole."""

    def __init__(self):
        super().__init__()
        self.areas: dict[int, list[int]] = {}
        self.first: dict[str, tuple[int, int]] = {}

    def element(self, tag, given):
        classes, (*_, dropped, areas, shown) = given.get("class", "").split(), self.open[-1] if self.open else (-1, (), True)
        role = "question" if "accordion" in classes else "answer" if "panel" in classes else tag if tag in WHOLE else None
        if tag in DROPPED or DROPPED_CLASS in classes:
            dropped = self.nodes
        shown = shown and tag not in ("script", "style")
        if tag == "div" and AREA in classes:
            areas = (*areas, self.nodes)
            if shown:
                self.areas[self.nodes] = [0, len(self.open)]
        if tag in ("main", "article", "body"):
            self.first.setdefault(tag, (self.nodes, len(self.open)))
        return self.nodes, tag, role, dropped, areas, shown

    def begun(self, element):
        if element[2] or element[1] in STARTS:
            super().begun(element)

    def handle_data(self, data):
        super().handle_data(data)
        if self.open and self.open[-1][-1] and data.strip():
            for area in self.open[-1][-2]:
                self.areas[area][0] += len(data)

    def found(self):
        if self.areas:
            root = max(self.areas, key=lambda node: (self.areas[node][0], -node))
            depth = self.areas[root][1]
        else:
            root, depth = next((self.first[tag] for tag in ("main", "article", "body") if tag in self.first), (None, 0))
        if root is not None:
            for text, path in self.runs:
                if len(path) > depth and path[depth][0] == root and path[-1][3] <= root:
                    yield text, path[depth + 1 :]


def _parsed(pages: DataFrame, id_col: str, html: str, kind: type[_Runs], columns: str) -> DataFrame:
    """The runs that a parser finds on each page, by columns, in batches of some megabytes."""
    schema = StructType.fromDDL(f"page {pages.schema[id_col].dataType.simpleString()}, {columns}")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        paths = arrow.field(3).type

        def made(rows):
            flat = [e for row in rows for e in row[3]]
            parts = zip(*flat, strict=True) if flat else [()] * paths.value_type.num_fields
            elements = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, paths.value_type, strict=False)], fields=list(paths.value_type))
            ends = pa.array(accumulate((len(row[3]) for row in rows), initial=0), pa.int32())
            columns = [pa.array([row[i] for row in rows], arrow.field(i).type) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, elements, type=paths)], schema=arrow)

        rows, weight = [], 0
        for batch in batches:
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parser = kind()
                parser.feed(source.as_py() or "")
                parser.close()
                for pos, (text, path) in enumerate(parser.found()):
                    rows.append((page, pos, text, path))
                    weight += len(text) + 16 * len(path)
                    if weight >= BATCH:
                        yield made(rows)
                        rows, weight = [], 0
        yield made(rows)

    return pages.select(F.col(id_col).alias("page"), html).mapInArrow(run, schema)


def text_runs(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, pos, text, path): each run of text of a page in order, with the elements from the outermost that it stands
    in; an empty run for the start of each element. An end tag closes the nearest open element of its name and all in
    it; other end tags don't count, and nothing is closed for being out of place. A null page has no run."""
    return _parsed(pages, id_col, html, _Runs, _RUN)


def content_runs(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, pos, text, under): the runs of each page's content, with the elements below the content's root. The root is
    the largest area of the content's class by text, else the first main, article or body; what isn't content goes, and
    so do the starts of elements that begin no block, part, cell or bold text. A page without an id has no run."""
    return _parsed(pages.where(F.col(id_col).isNotNull()), id_col, html, _Content, _CONTENT)


def _text(runs: Column) -> Column:
    """The text of sorted runs: joined by blanks, then normalised. Single blanks stay where they are, and a text without
    marks has only its ends left to trim."""
    joined = F.regexp_replace(F.array_join(F.transform(runs, lambda x: x["text"]), " "), r" \s+|[\t\n\x0B\f\r]\s*", " ")
    return F.get(F.transform(F.array(joined), lambda t: F.when(t.rlike(MARKED), normalize_text(t)).otherwise(F.trim(t))), 0)


def _joined(order: str = "pos") -> Column:
    """The text of a group of runs."""
    return _text(F.array_sort(F.collect_list(F.struct(order, "text"))))


def _cuts(sorted_array: str, *fields: str) -> Column:
    """The places in a sorted array at which a new value of the fields begins, from 0."""
    value = lambda i: F.struct(*[F.get(sorted_array, i)[f] for f in fields])
    places = F.when(F.size(sorted_array) > 0, F.sequence(F.lit(0), F.size(sorted_array) - 1))
    return F.filter(places, lambda i: (i == 0) | ~value(i).eqNullSafe(value(i - 1)))


def _pieces(array: str, cuts: str) -> Column:
    """The array cut at these places."""
    return F.transform(cuts, lambda at, n: F.slice(array, at + 1, F.coalesce(F.get(cuts, n + 1), F.size(array)) - at))


def content_blocks(runs: DataFrame) -> DataFrame:
    """(page, block, part, element, role, part_tag, text, strong, rows): the blocks of a page's content (content_runs) in
    document order.

    A block is the first element on the way down from the root that is taken whole: an accordion (question), a panel
    (answer), a heading, a table, a paragraph or an item. Only lists, plain containers and inline marks are entered on
    the way; text loose in them is a block of its own. An answer has a part for each of its paragraphs, items and cells
    that hold no paragraph or item themselves. strong: the text of a paragraph's or item's first bold element, null
    without one. rows: the texts of the cells of each row of a table that has a text, those of a table in a cell in both;
    null without such a row. Runs meet once, by page; what follows groups them where they are.
    """
    tag_in = lambda *tags: lambda e: e["tag"].isin(*tags)
    at, depth = F.col("at"), F.size("under")
    rows = runs.withColumn("at", F.array_position(F.transform("under", lambda e: e["role"].isNotNull()), True).cast("int"))
    rows = rows.where(~F.exists(F.slice("under", 1, F.when(at > 0, at - 1).otherwise(depth)), lambda e: ~e["tag"].isin(*WALKED)))
    taken, within = F.get("under", at - 1), F.when(at > 0, F.slice("under", at + 1, depth))
    rows = rows.select("page", "pos", "text", F.coalesce(taken["role"], F.lit("loose")).alias("role"), F.coalesce(taken["node"], -1 - F.col("pos")).alias("element"), within.alias("within"))
    rows, within, role = rows.where("role <> 'loose' or text <> ''"), F.col("within"), F.col("role")
    none = F.lit(None).cast("int")
    item = lambda part, tag, tr, cell: F.struct(part.alias("part"), tag.alias("part_tag"), tr.alias("tr"), cell.alias("cell"))
    parts = F.transform(F.filter(within, tag_in("p", "li", "td")), lambda e: item(e["node"], e["tag"], none, none))
    cells_of = lambda r: F.filter(within, lambda e: e["tag"].isin(*CELLS) & (e["node"] > r["node"]))
    cells = F.flatten(F.transform(F.filter(within, tag_in("tr")), lambda r: F.transform(cells_of(r), lambda c: item(none, none.cast("string"), r["node"], c["node"]))))
    own = F.get(within, F.size(within) - 1)
    rows = rows.select(
        "page", "pos", "text", "role", "element", F.when(role.isin(*PARAGRAPHS), F.get(F.filter(within, tag_in(*BOLD)), 0)["node"]).alias("bold"),
        F.when((role == "answer") & (F.col("text") == "") & own["tag"].isin(*PARAGRAPHS), own["node"]).alias("begins"),
        F.when(role == "answer", parts).when(role == "table", cells).alias("items"),
    ).repartition("page")
    rows = rows.select("page", "pos", "text", "role", "element", "bold", "begins", F.explode_outer("items").alias("item")).select("*", "item.*")
    told = F.array_sort(F.collect_list(F.struct("tr", "cell", "pos", "text")))
    bolds = F.array_sort(F.collect_list(F.when(F.col("bold").isNotNull(), F.struct("pos", "bold", "text"))))
    strong = F.when(F.min("bold").isNotNull(), _text(F.filter(bolds, lambda x: x["bold"] == F.min("bold"))))
    held = rows.groupBy("page", "element", "role", "part", "part_tag").agg(
        F.min("pos").alias("block"), F.when(role == "table", told).alias("told"), F.when(role != "table", _text(told)).alias("text"),
        strong.alias("strong"), F.bool_or(F.col("begins") != F.col("part")).alias("outer"),
    )
    # A table's texts are sorted by row, cell and place.
    held = held.withColumn("cuts", _cuts("told", "tr", "cell"))
    cells = F.transform(_pieces("told", "cuts"), lambda c: F.struct(F.get(c, 0)["tr"].alias("tr"), F.get(c, 0)["cell"].alias("cell"), _text(c).alias("text")))
    held = held.withColumn("cells", F.filter(cells, lambda c: c["cell"].isNotNull())).withColumn("cuts", _cuts("cells", "tr"))
    lines = F.transform(_pieces("cells", "cuts"), lambda r: F.transform(r, lambda c: c["text"]))
    held = held.withColumn("rows", F.filter(lines, lambda r: F.exists(r, lambda c: c != ""))).withColumn("rows", F.when(F.size("rows") > 0, F.col("rows")))
    # Parts of an answer, but for those in which another paragraph or item begins; without parts the answer as a whole.
    held = held.withColumn("parted", F.max("part").over(Window.partitionBy("page", "element")).isNotNull())
    held = held.where("(part is not null or not parted) and not coalesce(outer, false)")
    return held.select("page", "block", F.coalesce("part", F.lit(-1)).alias("part"), "element", "role", "part_tag", "text", "strong", "rows")


def table_cells(runs: DataFrame) -> DataFrame:
    """(page, tbl, tr, cell, direct, across, down, text): the cells of every table, those of a table in a cell in both,
    and a null cell for each row. direct: the cell is a child of the row."""
    own = F.get("path", F.size("path") - 1)
    starts = runs.where("text = ''").withColumn("own", own).where(F.col("own.tag").isin("td", "th", "tr"))
    rows = F.filter("path", lambda e: (e["tag"] == "tr") & ((F.col("own.tag") != "tr") | (e["node"] == F.col("own.node"))))
    tables = lambda row: F.filter(F.col("path"), lambda e: (e["tag"] == "table") & (e["node"] < row["node"]))
    pairs = F.flatten(F.transform(rows, lambda r: F.transform(tables(r), lambda t: F.struct(t["node"].alias("tbl"), r["node"].alias("tr")))))
    parent = F.get("path", F.size("path") - 2)["node"]
    cell = F.when(F.col("own.tag") != "tr", F.col("own.node"))
    cells = starts.select("page", cell.alias("cell"), "own.across", "own.down", parent.alias("parent"), F.explode(pairs).alias("in"))
    inner = F.transform(F.filter("path", lambda e: e["tag"].isin("td", "th")), lambda e: e["node"])
    told = runs.where("text <> ''").select("page", "pos", "text", F.explode(inner).alias("cell")).groupBy("page", "cell").agg(_joined().alias("text"))
    out = cells.join(told, ["page", "cell"], "left")
    direct = F.col("cell").isNotNull() & (F.col("in.tr") == F.col("parent"))
    return out.select("page", "in.tbl", "in.tr", "cell", direct.alias("direct"), "across", "down", F.coalesce("text", F.lit("")).alias("text"))


def spread(cells: list[tuple[str, int, int]], carried: dict[int, tuple[int, str]]) -> list[str]:
    """One row of a grid from its cells (text, across, down); carried, by column, is what earlier rows reach into it
    with (rows left, text), and is brought up to date."""
    row, cells = [], list(reversed(cells))
    while cells or len(row) in carried:
        if len(row) in carried:
            left, text = carried.pop(len(row))
            if left > 1:
                carried[len(row)] = (left - 1, text)
            row.append(text)
            continue
        text, across, down = cells.pop()
        for _ in range(across):
            if down > 1:
                carried[len(row)] = (down - 1, text)
            row.append(text)
    return row


def grids(cells: DataFrame) -> DataFrame:
    """(page, tbl, row, cells): tables as grids, each cell repeated in all columns and rows that it spans.

    row counts a table's rows that hold a text, from 0. Where spans overlap, a cell of the row itself wins. A table's
    rows come sorted to one task, which carries the open spans only.
    """
    direct = F.array_sort(F.collect_list(F.when(F.col("direct"), F.struct("cell", "text", "across", "down"))))
    rows = cells.groupBy("page", "tbl", "tr").agg(F.transform(direct, lambda c: F.struct(c["text"], c["across"], c["down"])).alias("cells"))
    schema = StructType([rows.schema["page"], rows.schema["tbl"], *StructType.fromDDL("row int, cells array<string>").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table, carried, row = to_arrow_schema(schema), None, {}, 0
        for batch in batches:
            out = []
            for page, tbl, found in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if (page, tbl) != table:
                    table, carried, row = (page, tbl), {}, 0
                texts = spread([tuple(c.values()) for c in found], carried)
                if any(texts):
                    out.append((page, tbl, row, texts))
                    row += 1
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.repartition("page", "tbl").sortWithinPartitions("page", "tbl", "tr").mapInArrow(run, schema)


def list_rows(grid: DataFrame) -> DataFrame:
    """(page, tbl, row, category, is_header, numbers, number_text, product, title, order): rows of official lists.

    A table is a list if its first row, in lower case, names a number column. A row of one value in all its cells that
    holds no number is a category for the rows after it; other rows count if their number cell has a number.
    """
    head = grid.where("row = 0").select("page", "tbl", F.transform("cells", F.lower).alias("heads"))

    def place(names: tuple[str, ...]) -> Column:
        hit = F.transform("heads", lambda h: F.exists(F.array(*map(F.lit, names)), lambda n: h.contains(n)))
        return F.array_position(hit, True).cast("int") - 1

    at = head.select("page", "tbl", *[F.nullif(place(names), F.lit(-1)).alias(f"at_{c}") for c, names in LIST_COLUMNS.items()]).where("at_number is not null")
    body = grid.where("row > 0").join(at, ["page", "tbl"])
    cell = lambda c: F.coalesce(F.trim(F.regexp_replace(F.get("cells", F.col(f"at_{c}")), r"\s+", " ")), F.lit(""))
    distinct = F.array_distinct(F.filter("cells", lambda c: c != ""))
    body = body.withColumns({"numbers": all_numbers(cell("number")), "only": F.when(F.size(distinct) == 1, F.get(distinct, 0))})
    header = F.col("only").isNotNull() & (F.size(all_numbers(F.coalesce("only", F.lit("")))) == 0)
    before = Window.partitionBy("page", "tbl").orderBy("row")
    body = body.withColumn("is_header", header).withColumn("category", F.last(F.when(F.col("is_header"), F.col("only")), ignorenulls=True).over(before))
    able = body.where(F.col("is_header") | (F.size("numbers") > 0))
    return able.select("page", "tbl", "row", "category", "is_header", "numbers", cell("number").alias("number_text"), *[cell(c).alias(c) for c in ("product", "title", "order")])


def page_sections(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, ord, number, heading, kind, text, rows): the clauses of each page with at least 150 characters of them.

    The first h1 is the page's title; other headings, and short paragraphs that are bold as a whole, begin sections
    "§n"; accordions begin questions "Qn", and panels answer them; tables are clauses "Table n"; other text belongs to
    the section before it, or to "§0 Introduction". Items get a bullet and noise lines go.
    """
    blocks = content_blocks(content_runs(pages, id_col, html))
    text, role = F.col("text"), F.col("role")
    # An answer without paragraphs, items and cells is kept whole, whatever its words.
    noise = (text == "") | (text.rlike(NOISE) & ((role != "answer") | (F.col("part") >= 0)))
    bold = role.isin(*PARAGRAPHS) & F.col("strong").isNotNull() & (F.col("strong") == text) & (F.length(text) < SHORT_HEADING) & ~text.rlike(r"[.:]$")
    keep = (
        F.when(role == "table", F.col("rows").isNotNull()).when(role.isin("question", "answer"), True)
        .when(role == "loose", ~noise & (F.length(text) > LOOSE_TEXT)).otherwise(~noise | bold)
    )
    order = Window.partitionBy("page").orderBy("block", "part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.where(keep).withColumns({"n": F.row_number().over(order), "noise": noise, "bold": bold})
    is_title = (role == "h1") & (F.count_if(role == "h1").over(order) == 1)
    section = ~is_title & (role.isin(*HEADINGS) | F.col("bold"))
    marked = marked.withColumns({"title": is_title, "section": section})
    # An answer begins a question without words where the clause before it is none.
    asked = F.last(F.when(role.isin("question", "answer"), True).when(F.col("section"), False), ignorenulls=True).over(earlier)
    first_part = F.coalesce(F.lag("element").over(order) != F.col("element"), F.lit(True))
    unasked = (role == "answer") & first_part & ~F.coalesce(asked, F.lit(False))
    opens = F.when(F.col("section"), "section").when((role == "question") | unasked, "question").when(role == "table", "table")
    marked = marked.withColumn("opens", opens)
    # Tables take no text: it goes on with the clause before them, or with the introduction where there is none.
    opens, held = F.col("opens"), F.last(F.when(F.col("opens").isin("section", "question"), F.col("n")), ignorenulls=True).over(order)
    marked = marked.withColumn("held", held)
    intro = F.min(F.when(F.col("held").isNull() & opens.isNull() & ~F.col("title"), F.col("n"))).over(Window.partitionBy("page"))
    count = lambda kind: F.count_if(opens == kind).over(order).cast("string")
    number = (
        F.when(opens == "section", F.concat(F.lit("§"), count("section"))).when(opens == "question", F.concat(F.lit("Q"), count("question")))
        .when(opens == "table", F.concat(F.lit("Table "), count("table")))
    )
    heading = F.when(opens == "section", text).when(role == "question", F.trim(F.regexp_replace(text, QUESTION, ""))).when(opens.isNotNull(), "")
    bullet = F.when((role == "li") | (F.col("part_tag") == "li"), "• ").otherwise("")
    piece = F.when(role == "table", rows_to_markdown(F.col("rows"))).when((opens.isNull() | (role == "answer")) & ~F.col("noise"), F.concat(bullet, text))
    lines = marked.where("not title").select(
        "page", "n", F.when(opens.isNotNull(), F.col("n")).otherwise(F.coalesce("held", intro)).alias("clause"),
        number.alias("number"), heading.alias("heading"), opens.alias("opens"), piece.alias("piece"), "rows",
    )
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("n", "piece")))), lambda x: x["piece"]), "\n\n")
    out = lines.groupBy("page", "clause").agg(F.max("number").alias("number"), F.max("heading").alias("heading"), F.max("opens").alias("opens"), told.alias("text"), F.max("rows").alias("rows"))
    kind = F.when(F.col("opens") == "question", "faq").when(F.col("opens") == "table", "table").otherwise("other")
    out = out.select("page", "clause", F.coalesce("number", F.lit("§0")).alias("number"), F.coalesce("heading", F.lit("Introduction")).alias("heading"), kind.alias("kind"), "text", "rows")
    out = out.where("text <> '' or heading <> ''").withColumn("total", F.sum(F.length("text") + F.length("heading")).over(Window.partitionBy("page")))
    place = F.row_number().over(Window.partitionBy("page").orderBy("clause")) - 1
    return out.where(F.col("total") >= MIN_TEXT).select("page", place.alias("ord"), "number", "heading", "kind", "text", "rows")


def last_updated(runs: DataFrame) -> DataFrame:
    """(page, updated): the date after "Last Updated on", null where a page has none."""
    told = runs.where(~F.exists("path", lambda e: e["tag"].isin("script", "style"))).groupBy("page").agg(_joined().alias("text"))
    return told.select("page", F.nullif(F.regexp_extract("text", UPDATED, 1), F.lit("")).alias("updated"))
