"""Clause trees against known documents and a plain loop over whole documents."""

import re

import pytest

from quarry.functions.cleaning import HEADING_KINDS
from quarry.operators import clauses as cs
from quarry.plans.clauses import laid_out

SCHEMA = "doc long, ord int, page int, text string, size double, bold boolean, x0 double, rows array<array<string>>"


def line(text, bold=False, size=10.0, x0=56.0, page=1, rows=None):
    return (page, text, size, bold, x0, rows)


def tree(spark, *documents):
    rows = [(d, i, *ln) for d, lines in enumerate(documents) for i, ln in enumerate(lines)]
    found = {}
    for r in cs.clause_tree(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("doc", "clause").collect():
        found.setdefault(r.doc, []).append(r)
    return [found.get(d, []) for d in range(len(documents))]


def test_numbers_kinds_and_parents(spark):
    whole, wrapped, unit, lone = tree(
        spark,
        [line("FOREWORD", True, 12.0), line("This is a foreword."), line("1 SCOPE", True), line("1.1 This standard covers widgets."), line("4 REQUIREMENTS", True),
         line("4.1 General", True), line("4.1.1 The widget shall be blue."), line("4.2 Marking - Each widget shall be marked.", page=2), line("It shows.", page=3)],
        [line("4 REQUIREMENTS", True), line("4.4 The helmet shall meet Table 1 when tested as prescribed in clause"), line("8."), line("5 PACKING", True), line("5.1 Each helmet shall be packed.")],
        [line("4 REQUIREMENTS", True), line("4.3 Coliform bacteria shall be absent in any"), line("250 ml sample of the water.")],
        [line("1."), line("2."), line("Short title"), line("3"), line("Next title")],
    )
    assert [c.number for c in whole] == ["Foreword", "1", "1.1", "4", "4.1", "4.1.1", "4.2"]
    by = {c.number: c for c in whole}
    assert (by["1.1"].kind, by["4.1.1"].kind, by["Foreword"].kind) == ("scope", "requirement", "foreword")
    assert by["4.1"].heading == "General" and (by["4.2"].heading, by["4.2"].text) == ("Marking", "Each widget shall be marked.\n\nIt shows.")
    assert whole[by["4.1.1"].parent].number == "4.1" and (by["4"].page_end, by["4.1"].page_end, by["4.2"].page_end) == (3, 1, 3)
    assert [c.number for c in wrapped] == ["4", "4.4", "5", "5.1"]
    assert wrapped[1].text.endswith("as prescribed in clause 8.")
    assert [c.number for c in unit] == ["4", "4.3"]
    assert [(c.number, c.text) for c in lone] == [("Front", "1. 2.\n\nShort title"), ("3", "Next title")]


def test_tables_notes_annexes_and_repeats(spark):
    cells = [["A", "B"], ["1", "2 | 3"]]
    (found,) = tree(
        spark,
        [line("Loose text."), line("1 SCOPE", True), line("Table 1 Limits - "), line("lost words"), line("", rows=cells), line("after the table;"), line("a) item"),
         line("", rows=cells, page=2), line("1.1 Lower"), line("Heading of", x0=20.0), line("margin", x0=20.0), line("2. the lower start is refused"), line("2. The text goes here."),
         line("Use 3. With a note", x0=20.0), line("ANNEX B METHODS", True), line("B-1 First"), line("B-1.1 Second"), line("CONTENTS", True), line("B-1 Again", True)],
    )
    got = [(c.unique_number, c.heading, c.level, c.kind, c.parent, c.text.replace("\n", "/")) for c in found]
    table = "| A | B |/|---|---|/| 1 | 2 / 3 |"
    assert got[:3] == [("Front", "Front matter", 1, "front", None, "Loose text."), ("1", "Scope", 1, "scope", None, ""), ("Table 1", "Limits", 2, "table", 1, table + "//after the table;//a) item")]
    assert got[3] == ("Table (p. 2)", "", 2, "table", 1, table)
    assert got[4] == ("1.1", "", 2, "scope", 1, "Lower [Heading of margin] 2. the lower start is refused")
    assert got[5:7] == [("2", "", 1, "other", None, "The text goes here."), ("3", "Use", 1, "other", None, "With a note")]
    assert got[7:] == [
        ("Annex B", "METHODS", 1, "test_method", None, ""), ("B-1", "", 2, "test_method", 7, "First"), ("B-1.1", "", 3, "test_method", 8, "Second"),
        ("Contents", "", 1, "other", None, ""), ("B-1 (2)", "Again", 2, "other", 10, ""),
    ]


def test_nulls_and_no_lines(spark):
    rows = [(1, 0, None, None, None, None, None, None), (2, 0, None, "text", None, None, None, None), (None, 3, 4, "1 One", 9.0, True, 0.0, None)]
    got = cs.clause_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc, r.number, r.page_start, r.text) for r in got} >= {(2, "Front", 1, "text")}
    assert cs.clause_tree(spark.createDataFrame([], SCHEMA)).count() == 0


def capitals(text):
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) > 0.8 * len(letters)


def kind_of(text):
    return next((kind for word, kind in HEADING_KINDS if word in text.upper()), "other")


def loop(lines):
    """One document's clauses, line after line: dicts in order."""
    sizes, edges = {}, {}
    for page, text, size, bold, x0, rows in lines:
        if rows is None:
            sizes[size] = sizes.get(size, 0) + len(text)
            edges[round(x0)] = edges.get(round(x0), 0) + 1
    body = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 10.0
    margin = min(edges, key=lambda x: (-edges[x], x)) if edges else 0
    whole = []
    for page, text, size, bold, x0, rows in lines:
        if whole and whole[-1][5] is None:
            p = whole[-1]
            if re.search(r"^\d{1,2}(\.\d{1,3})*\.?$", text) and not re.search(r"[.:;)\]]$", p[1]) and re.search(cs.UNFINISHED, p[1]):
                whole[-1] = (p[0], f"{p[1]} {text}", *p[2:])
                continue
            if re.search(r"^\d{1,2}\.?$", p[1]) and rows is None and page == p[0]:
                whole[-1] = (page, f"{p[1].rstrip('.')}. {text}", max(size, p[2]), bold or p[3], p[4], None)
                continue
        whole.append((page, text, size, bold, x0, rows))
    out, numbers, notes, pieces, seen, pages = [], {}, [], [], {}, set()
    at, top, last = None, None, 0

    def close():
        if at is not None and pieces:
            joined = ""
            for x in filter(None, (x.strip() for x in pieces)):
                joined = x if not joined else joined[:-1] + x if re.search("[a-z]-$", joined) and re.match("[a-z]", x) else f"{joined} {x}"
            out[at]["paragraphs"].append(joined)
        pieces.clear()

    def begin(number, heading, kind, parent, page):
        out.append({"number": number, "heading": heading, "kind": kind, "parent": parent, "level": 1 if parent is None else out[parent]["level"] + 1, "start": page, "end": page, "paragraphs": [], "rows": None})
        return len(out) - 1

    for page, text, size, bold, x0, rows in whole:
        text, first = text.strip(), page not in pages
        pages.add(page)
        large = bold or size > body + 0.5
        if rows is not None:
            close()
            if at is not None and out[at]["kind"] == "table" and out[at]["rows"] is None:
                out[at].update(rows=rows, paragraphs=[], end=page)
            else:
                at = begin(f"Table (p. {page})", "", "table", top if at is None or out[at]["kind"] == "table" else at, page)
                out[at]["rows"] = rows
            continue
        if not text:
            continue
        if margin and x0 < margin - 15:
            led = re.match(cs.MARGIN_NOTE, text)
            if led:
                notes.append(led[1])
                text, x0 = led[2], margin
            elif len(text) < 40 and not re.match(cs.NUMBERED, text):
                notes.append(text)
                continue
        if re.match(cs.TOP, text) and (large or capitals(text)) and (first or not text.upper().startswith("ANNEXURE")):
            close()
            annex, annexure, amended = (re.match(p, text) for p in (cs.ANNEX, cs.ANNEXURE, cs.AMENDMENT))
            if annex:
                named = (f"Annex {annex[1].upper()}", annex[2].strip())
            elif annexure:
                named = (f"Annexure-{annexure[1].upper()}" + (f" {annexure[2].upper()}" if annexure[2] else ""), annexure[3].strip(" -–:"))
                last = 0
            elif amended:
                named = (f"Amendment No. {amended[1]}", amended[2].title() if amended[2].isupper() else amended[2].strip())
            else:
                named = (text.title(), "")
            at = top = begin(*named, kind_of(text), None, page)
            numbers, notes = {}, []
            continue
        caption = re.match(cs.CAPTION, text)
        if caption and (bold or len(text) < 120) and not re.search(cs.IN_TEXT, text):
            close()
            at = begin(f"Table {caption[1]}", caption[2].strip(" -–—"), "table", out[at]["parent"] if at is not None and out[at]["kind"] == "table" else at, page)
            continue
        found = re.match(cs.NUMBERED, text) or re.match(cs.LETTERED, text)
        if found and margin - 30 < x0 < margin + 60:
            number, rest = found[1], found[3].strip()
            above = number.rpartition(".")[0]
            fits = not rest or re.match(cs.CAPITAL_START, rest) or (above in numbers and not re.match(cs.UNIT_START, rest))
            if number[0].isdigit() and fits:
                if above:
                    fits = above in numbers or number.split(".")[0] == str(last)
                else:
                    ahead, strong = int(number) - last, large or capitals(rest)
                    fits = 0 < int(number) <= 60 and (0 < ahead <= 3 and (strong or found[2] or rest) or 0 < ahead <= 5 and strong)
            if fits:
                close()
                parent = None if number.isdigit() else numbers.get(above, top)
                short = len(rest) <= 80 and rest[-1:] not in tuple(".:;") and rest and not rest.startswith("(") and not re.search(cs.SENTENCE, rest)
                dash = re.match(cs.HEAD_DASH, rest)
                if short and (large or capitals(rest)):
                    heading, told = (rest.title() if capitals(rest) and len(rest) > 3 else rest), ""
                elif dash and len(dash[1]) <= 60 and not re.search(cs.HEAD_SENTENCE, dash[1]):
                    heading, told = dash[1].strip(), dash[2].strip()
                else:
                    heading, told = "", rest
                heading = heading or " ".join(notes)
                notes = []
                inherited = parent is not None and out[parent]["kind"] not in ("table", "other", "front")
                at = begin(number, heading, out[parent]["kind"] if inherited else kind_of(heading if parent is not None else heading or rest), parent, page)
                numbers[number] = at
                if number.isdigit():
                    last, top = int(number), at
                if told:
                    pieces.append(told)
                continue
        if at is None:
            at = begin("Front", "Front matter", "front", None, page)
        if notes:
            pieces.append("[" + " ".join(notes) + "]")
            notes = []
        if pieces and (re.match(cs.LIST_ITEM, text) or pieces[-1][-1] in ".:;"):
            close()
        pieces.append(text)
        up = at
        while up is not None:
            out[up]["end"] = max(out[up]["end"], page)
            up = out[up]["parent"]
    close()
    for c in out:
        seen[c["number"]] = n = seen.get(c["number"], 0) + 1
        c["unique"] = c["number"] if n == 1 else f"{c['number']} ({n})"
    return out


def test_whole_documents_against_a_loop(spark):
    lines = laid_out(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    documents = {}
    for r in lines.orderBy("doc", "ord").collect():
        documents.setdefault(r.doc, []).append((r.page, r.text, r["size"], r.bold, r.x0, r.rows))
    got = {}
    for r in cs.clause_tree(lines).orderBy("doc", "clause").collect():
        table = "" if r.rows is None else r.text.split("\n\n")[0]
        got.setdefault(r.doc, []).append((r.number, r.unique_number, r.heading, r.level, r.kind, r.parent, r.page_start, r.page_end, r.rows, r.text[len(table) :].lstrip("\n")))
    want = {
        d: [(c["number"], c["unique"], c["heading"], c["level"], c["kind"], c["parent"], c["start"], c["end"], c["rows"], "\n\n".join(filter(None, c["paragraphs"]))) for c in loop(ls)]
        for d, ls in documents.items()
    }
    assert got.keys() == {d for d in want if want[d]}
    for d in got:
        assert got[d] == want[d], d
    kinds = {(c[4], c[3]) for cs_ in want.values() for c in cs_}
    assert len(kinds) > 8




def test_annex_numbers_end_on_a_cycle(spark):
    from quarry.operators.structure import annex_numbers

    rows = [(1, 0, 1, "1"), (1, 1, 2, "1.1"), (1, 2, 0, "1.1.1"), (2, 0, None, "Annex B"), (2, 1, 0, "3"), (2, 2, 1, "3.1"), (2, 3, None, "4")]
    frame = spark.createDataFrame(rows, "doc_id int, node int, parent int, number string")
    assert {r.qualified for r in annex_numbers(frame.where("doc_id = 2")).collect()} == {"Annex B", "B-3", "B-3.1", "4"}
    with pytest.raises(ValueError, match="ancestors"):
        annex_numbers(frame)


def test_chunks_of_a_tree(spark):
    from quarry.operators.chunking import clause_chunks

    cells = [["h1", "h2"], *[[str(i), "x"] for i in range(45)]]
    long_ = [line(f"Sentence {i} states that the product shall comply.") for i in range(120)]
    tree_ = spark.createDataFrame([(1, i, *ln) for i, ln in enumerate([line("1 SCOPE", True), line("Table 1 Limits"), line("", rows=cells), line("2 TESTS", True), *long_])], SCHEMA)
    got = clause_chunks(cs.clause_tree(tree_), ["doc", "clause"]).orderBy("clause", "ord").collect()
    tables = [r for r in got if r.clause == 1]
    assert [r.ord for r in tables] == [0, 1, 2] and all(r.chunk.startswith("Limits\n| h1 | h2 |\n|---|---|\n") for r in tables)
    assert [r.chunk.count("| x |") for r in tables] == [20, 20, 5]
    words = [r for r in got if r.clause == 2]
    assert len(words) > 1 and all(r.tokens <= 470 for r in words) and all(f"Sentence {i} " in " ".join(r.chunk for r in words) for i in range(120))
    assert not [r for r in got if r.clause == 0]  # a heading alone has no text


def test_no_table_of_the_tree_goes_through_the_driver(spark, tmp_path):
    from quarry.plans.registry import QUERIES

    spark.createDataFrame([(i, "SCOPE\nThis line is plain.\n4.1 A line") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clause_rows", "clause_labels"):
        out = QUERIES[name](spark, str(tmp_path))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString(), name
        assert out.collect()
