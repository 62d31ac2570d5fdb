"""Glossary files, manifests and sheets as files."""

import random

from pyspark.sql import functions as F

from quarry.operators import present as pr
from quarry.sources import glossary as gl
from quarry.sources import manifest as mf
from quarry.sources import sinks

TEXT = """# a comment
synonyms:
  tmt bars: [deformed bars, "high strength"]
  # another
  'isi mark': [Standard Mark]
  broken line
do_not_translate:
  - TMT
  - "IS 1786"
"""


def test_glossary_from_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TEXT)
    (tmp_path / "empty.txt").write_text("")
    found = gl.load(spark, str(tmp_path))
    got = {(r.section, r.key, tuple(r.terms)) for r in found.collect()}
    assert got == {("synonyms", "tmt bars", ("deformed bars", "high strength")), ("synonyms", "isi mark", ("Standard Mark",)), ("do_not_translate", None, ("TMT",)), ("do_not_translate", None, ("IS 1786",))}
    assert {r.term for r in gl.protected(found).collect()} == {"TMT", "IS 1786"}
    keys = gl.synonyms(found, "synonyms")
    asked = spark.createDataFrame([("Which TMT bar's best?",), ("ISI-mark here",), ("an isi marks",), ("disisi mark",)], "q string")
    hits = {(r.q, r.key) for r in asked.crossJoin(keys).where(gl.has_key(asked["q"], keys["key"])).select("q", "key").collect()}
    assert hits == {("ISI-mark here", "isi mark"), ("an isi marks", "isi mark")}


def test_sample_manifest_is_saved_in_order(spark, tmp_path):
    docs = spark.createDataFrame([("b.md", "---\nnumber: DEMO-2\ntitle: \"Two\"\n---\nbody"), ("a.md", "---\nnumber: DEMO-1\ntitle: One\n---\n"), ("c.md", "no header")], "file string, text string")
    entries = mf.sample_entries(docs)
    assert {(r.file, r.standard_number, r.title) for r in entries.collect()} == {("a.pdf", "DEMO-1", "One"), ("b.pdf", "DEMO-2", "Two")}
    mf.save(entries, str(tmp_path / "m"))
    assert [r.file for r in spark.read.json(str(tmp_path / "m")).collect()] == ["a.pdf", "b.pdf"]
    assert [r[0] for r in spark.createDataFrame([("demo",), ("sample",), ("x",), (None,)], "d string").select(mf.mode(F.col("d"))).collect()] == ["sample", "sample", "official", "official"]


def test_sheets_as_files(spark, tmp_path):
    items = [("s-1", "IS 1", True, 1, "4.2", 3, "shall_not", 'with "quotes", and\nlines'), ("s-1", "IS 1", True, 0, "4", None, "must", "plain"), ("s-2", "IS 2", False, 0, None, 1, "may", "x")]
    frame = spark.createDataFrame(items, "slug string, label string, synthetic boolean, ord int, clause string, page int, modality string, text string")
    sinks.write_sheets(pr.requirement_sheet(frame), str(tmp_path / "sheets"))
    import csv

    (file,) = (tmp_path / "sheets" / "slug=s-1").glob("*.txt")
    raw = file.read_bytes()
    assert raw.startswith("﻿".encode())
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    assert rows[1] == ["Synthetic demo data, not an Indian Standard."] and rows[2] == list(pr.SHEET)
    assert rows[3:] == [["IS 1", "4", "", "MUST", "plain", "", "", ""], ["IS 1", "4.2", "3", "SHALL NOT", 'with "quotes", and\nlines', "", "", ""]]
    (other,) = (tmp_path / "sheets" / "slug=s-2").glob("*.txt")
    assert len(other.read_text().splitlines()) == 3


def test_suggested_questions_against_a_loop(spark):
    rng, padding = random.Random(3), ("First?", "Is BIS certification compulsory for n1?")
    draw = lambda qids: [(rng.choice(qids), rng.randrange(6), rng.choice(["n1", "n2", "n3", "", None])) for _ in range(150)]
    asked, phrases, products = list(range(60)), draw(range(25)), draw(range(15, 50))
    rows = lambda found, name: spark.createDataFrame(found, f"qid long, pos long, {name} string")
    applies, compulsory = "Which Indian Standard applies to {}?".format, "Is BIS certification compulsory for {}?".format
    said = lambda make, x: None if x is None else make(x)
    for most in (1, 2, 3):
        out = pr.suggested_questions(spark.createDataFrame([(q,) for q in asked], "qid long"), rows(phrases, "phrase"), rows(products, "product"), padding, most)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Exchange hashpartitioning"), plan.count("Sort [")) == (1, 1)
        got = {}
        for r in out.orderBy("qid", "place").collect():
            got.setdefault(r.qid, []).append(r.question)
            assert r.place == len(got[r.qid])
        for q in asked:
            worded = [(0, pos, nth, said(make, x)) for i, pos, x in phrases if i == q for nth, make in enumerate((applies, compulsory))]
            worded = worded or [(1, pos, 0, said(compulsory, x)) for i, pos, x in products if i == q]
            worded.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or ""))
            assert got[q] == list(dict.fromkeys([x[3] for x in worded] + list(padding)))[:most], (q, most)
