"""Page sections and tables against a tree of elements built by html.parser."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.functions.cleaning import normalize_text
from quarry.sources import elements as el

VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    def __init__(self, tag, classes=(), spans=(1, 1)):
        self.tag, self.classes, self.spans, self.children = tag, classes, spans, []

    def all(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.all()

    def strings(self):
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            else:
                yield c

    def text(self):
        return re.sub(r"\s+", " ", " ".join(s for s in self.strings() if s.strip())).strip()


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = Node("[page]")
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) else 1
        node = Node(tag, (a.get("class") or "").split(), (number("colspan"), number("rowspan")))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def find(node, *tags):
    return [n for n in node.all() if n.tag in tags]


def sections(html):
    page = Tree(html).root
    shown = lambda n: sum(len(s) for m in [n, *n.all()] if m.tag not in ("script", "style") for s in m.children if isinstance(s, str) and s.strip())
    areas = [n for n in find(page, "div") if "who_we_area" in n.classes]
    root = max(areas, key=shown) if areas else next((n for t in ("main", "article", "body") for n in find(page, t)[:1]), None)
    if root is None:
        return []

    def prune(n):
        n.children = [c for c in n.children if isinstance(c, str) or (c.tag not in el.DROPPED and "fbc" not in c.classes)]
        for c in n.children:
            if isinstance(c, Node):
                prune(c)

    prune(root)
    out, state = [], {"at": None, "§": 0, "Q": 0, "T": 0, "title": None}

    def begin(number, heading, kind):
        out.append([number, heading, kind, [], None])
        return out[-1]

    def add(text):
        if text and not re.match(el.NOISE, text):
            state["at"] = state["at"] or begin("§0", "Introduction", "other")
            state["at"][3].append(text)

    def section(text):
        state["§"] += 1
        state["at"] = begin(f"§{state['§']}", text, "other")

    def walk(node):
        for c in node.children:
            if isinstance(c, str):
                t = re.sub(r"\s+", " ", c).strip()
                if len(t) > 2:
                    add(t)
            elif "accordion" in c.classes:
                state["Q"] += 1
                state["at"] = begin(f"Q{state['Q']}", re.sub(el.QUESTION, "", c.text()).strip(), "faq")
            elif "panel" in c.classes:
                if state["at"] is None or state["at"][2] != "faq":
                    state["Q"] += 1
                    state["at"] = begin(f"Q{state['Q']}", "", "faq")
                items = find(c, "p", "li", "td")
                for it in items:
                    t = it.text()
                    if not find(it, "p", "li") and t and not re.match(el.NOISE, t):
                        state["at"][3].append(("• " if it.tag == "li" else "") + t)
                if not items and c.text():
                    state["at"][3].append(c.text())
            elif c.tag in el.HEADINGS:
                t = c.text()
                if not t or re.match(el.NOISE, t):
                    continue
                if c.tag == "h1" and state["title"] is None:
                    state["title"] = t
                else:
                    section(t)
            elif c.tag == "table":
                rows = [[d.text() for d in find(r, "td", "th")] for r in find(c, "tr")]
                rows = [r for r in rows if any(r)]
                if rows:
                    state["T"] += 1
                    begin(f"Table {state['T']}", "", "table")[4] = rows
            elif c.tag in ("p", "li"):
                t, strong = c.text(), find(c, "strong", "b")[:1]
                if strong and strong[0].text() == t and len(t) < 90 and not t.endswith((".", ":")):
                    section(t)
                else:
                    add(("• " if c.tag == "li" and t else "") + t if t and not re.match(el.NOISE, t) else "")
            elif c.tag in el.WALKED:
                walk(c)

    walk(root)
    made = [(n, h, k, "\n\n".join(p) if r is None else None, r) for n, h, k, p, r in out if p or h or r]
    total = sum(len(h) + (len(t) if r is None else 150) for _, h, _, t, r in made)
    return made if total >= 150 else []


def random_page(rng, i):
    """A page with nested and unclosed elements."""
    words = lambda a, b: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta.", "é", "&amp;", "1", "x > y", "Home"]) for _ in range(rng.randrange(a, b)))
    out = ["<!DOCTYPE html><html><head><title>t</title><style>p {}</style></head><body>" if i % 5 else ""]
    for _ in range(rng.randrange(3, 25)):
        tag = rng.choice(["p", "div", "h1", "h2", "ul", "li", "b", "span", "table", "tr", "td", "article", "main", "script", "nav", "strong", "br", "center", "section", "th"])
        extra = rng.choice(["", "", "", ' class="accordion"', ' class="panel x"', ' class="who_we_area"', ' class="fbc"', ' colspan="2"', ' title="a > b"'])
        out.append(rng.choice([f"<{tag}{extra}>{words(0, 12)}", f"<{tag}{extra}>{words(0, 5)}</{tag}>", f"</{tag}>", words(1, 9), "<!-- <p>no</p> -->", f"<{tag}{extra}/>", f"<table><tr><td>{words(0, 3)}</td><th>b <b>c</b></td></tr><tr></tr><tr><td>{words(0, 2)}<table><tr><td>in</table></table>"]))
    return "".join(out) + words(30, 60)


def test_malformed_pages_against_a_tree(spark):
    rng = random.Random(11)
    pages = [random_page(rng, i) for i in range(400)]
    pages += ["", None, "no tags at all " * 30, "<body><p>short</p></body>", "<body><div class=who_we_area>" + "a b " * 50 + "<p>in<div class=who_we_area>inner</div></div><main>" + "c " * 90]
    rows = [(i, p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    got = {}
    for r in el.page_sections(frame).orderBy("page", "ord").collect():
        got.setdefault(r.page, []).append((r.number, r.heading, r.kind, r.text if r.rows is None else None, r.rows))
    want = {i: sections(p or "") for i, p in rows}
    # The floor on a page's text counts tables by their Markdown, which this loop doesn't build.
    table = {i for i, s in want.items() if any(r for *_, r in s)}
    assert {i: s for i, s in want.items() if s and i not in table} == {i: s for i, s in got.items() if i not in table}
    assert all(got[i] == want[i] for i in table if i in got) and len(table & got.keys()) > 20


def test_given_pages_against_a_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {}
    for r in el.page_sections(pages).orderBy("page", "ord").collect():
        got.setdefault(r.page, []).append((r.number, r.heading, r.kind, r.text, r.rows))
    want = {r.page_id: sections(r.html) for r in pages.collect()}
    assert got == {i: s for i, s in want.items() if s} and got


def grid(table):
    """The table as a grid, cell by cell."""
    out, carry = [], {}
    for tr in find(table, "tr"):
        cells, row = [n for n in tr.children if isinstance(n, Node) and n.tag in ("td", "th")], []
        while cells or len(row) in carry:
            at = len(row)
            if at in carry:
                left, text = carry.pop(at)
                row.append(text)
                if left > 1:
                    carry[at] = (left - 1, text)
            else:
                cell = cells.pop(0)
                for k in range(cell.spans[0]):
                    row.append(cell.text())
                    if cell.spans[1] > 1:
                        carry[at + k] = (cell.spans[1] - 1, cell.text())
        if any(row):
            out.append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_nested_and_overlapping(spark, seed):
    rng, pages = random.Random(seed), []

    def table(deep):
        rows = []
        for _ in range(rng.randrange(1, 6)):
            cells = []
            for _ in range(rng.randrange(0, 5)):
                span = rng.choice(["", "", f' colspan="{rng.randrange(0, 4)}"', f" rowspan={rng.randrange(0, 4)}", ' colspan="2" rowspan="3"', ' rowspan="x"'])
                inner = table(deep + 1) if deep < 2 and rng.random() < 0.1 else rng.choice(["", "a", "b c", "d<br>e", " "])
                cells.append(f"<{rng.choice(['td', 'th'])}{span}>{inner}{rng.choice(['</td>', '</th>', ''])}")
            rows.append("<tr>" + "".join(cells) + rng.choice(["</tr>", "</tr>", ""]))
        return "<table>" + "".join(rows) + "</table>"

    for _ in range(60):
        pages.append("<body>" + table(0) + table(0))
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in el.grids(el.table_cells(el.text_runs(frame))).orderBy("page", "tbl", "row").collect():
        got.setdefault((r.page, r.tbl), []).append(r.cells)
    for i, p in enumerate(pages):
        assert [got[k] for k in sorted(got) if k[0] == i] == [g for g in map(grid, find(Tree(p).root, "table")) if g]


def test_official_list(spark):
    html = """<body><table><tr><th>Sl</th><th>IS No.</th><th>Product</th><th>Notification</th></tr>
    <tr><td colspan=4>Cement</td></tr><tr><td>1</td><td rowspan=2>IS 269:2015</td><td>Ordinary  cement</td><td>Order A</td></tr>
    <tr><td>2</td><td>Other cement</td><td></td></tr><tr><td>3</td><td>none</td><td>x</td><td>y</td></tr>
    <tr><td colspan=4>Steel</td></tr><tr><td>4</td><td>IS 1786:2008 and IS 2062</td><td>Bars</td><td>Order B</td></tr></table>
    <table><tr><td>a</td></tr><tr><td>IS 5:2007</td></tr></table></body>"""
    frame = spark.createDataFrame([(7, html)], "page_id long, html string")
    got = el.list_rows(el.grids(el.table_cells(el.text_runs(frame)))).orderBy("row").collect()
    assert [(r.row, r.category, r.is_header, list(r.numbers), r.product, r.order) for r in got] == [
        (1, "Cement", True, [], "Cement", "Cement"), (2, "Cement", False, ["IS 269:2015"], "Ordinary cement", "Order A"),
        (3, "Cement", False, ["IS 269:2015"], "Other cement", ""), (5, "Steel", True, [], "Steel", "Steel"),
        (6, "Steel", False, ["IS 1786:2008", "IS 2062"], "Bars", "Order B"),
    ]


def test_deep_pages_stay_bounded(spark):
    frame = spark.createDataFrame([(1, "<body>" + "<div>" * 3000 + "word " * 60)], "page_id long, html string")
    assert [r.text for r in el.page_sections(frame).collect()] == [("word " * 60).strip()]
    assert el.last_updated(el.text_runs(spark.createDataFrame([(1, "<p>Last Updated on <b>May 3, 2024</b>")], "page_id long, html string"))).first().updated == "May 3, 2024"


def test_runs_of_sections_meet_once(spark):
    table = "".join(f"<tr><td>{i}</td><td>b</td><th></th></tr>" for i in range(3000)) + "<tr><td></td></tr>"
    html = f"<body><h1>T</h1><div class=panel>loose<p>one<p>two</p></div><table>{table}</table>" + "<p><b>Bold</b></p><p>rest</p>" * 20
    frame = spark.createDataFrame([(1, html), (2, None), (None, html)], "page_id long, html string")
    out = el.page_sections(frame)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.number: r for r in out.collect()}
    assert {r.page for r in got.values()} == {1} and got["Table 1"].rows == [[str(i), "b", ""] for i in range(3000)]
    assert (got["Q1"].text, got["§20"].heading, got["§20"].text) == ("two", "Bold", "rest")


def test_texts_of_runs_are_normalised(spark):
    rng, marks = random.Random(5), "ab  \t\n\r\f\x0b\x1c\x85\xa0\xad\u200b\u200c\u200d\u2003\u2028\u2060\ufeff\ufb00\ufb03\ufb04é"
    rows = [(i, pos, "".join(rng.choice(marks) for _ in range(rng.randrange(0, 12)))) for i in range(400) for pos in range(3)]
    got = spark.createDataFrame(rows, "id int, pos int, text string").groupBy("id").agg(el._joined().alias("got"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("runs"))
    plain = F.regexp_replace(F.array_join("runs.text", " "), r"\s+", " ")
    assert got.count() == 400 and got.where(F.col("got") != normalize_text(plain)).count() == 0
