import json
from pathlib import Path

from pyspark.sql import functions as F

from quarry.sources import manifest as mf
from quarry.sources import sinks


def test_versions_and_pointer(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root, "v1")
    sinks.publish(spark.range(5), root, "v2")
    assert sinks.current(spark, root).count() == 5
    sinks.publish(spark.range(2), root, "v1")
    assert sinks.current(spark, root).count() == 2


def test_requirement_csv_has_the_columns_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("It shall, \"always\", hold.", "shall", 3)], "sentence string, modality string, page int")
    sinks.write_requirements(rows, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in Path(tmp_path / "r").glob("*.csv"))
    assert text.splitlines()[0].split(",") == list(sinks.REQUIREMENT_COLUMNS)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r")).first()
    assert back.sentence == 'It shall, "always", hold.' and back.page == "3" and back.topic is None


def test_report_has_groups_and_a_total(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc string, n int")
    sinks.write_report(rows, "doc", {"large": "n > 1"}, str(tmp_path / "j"))
    lines = [json.loads(x) for p in Path(tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert {(x.get("doc"), x["rows"], x["large"]) for x in lines} == {("a", 2, 1), ("b", 1, 1), (None, 3, 2)}


def test_manifest_override_defaults_and_drafts(spark):
    raw = spark.createDataFrame([("a.pdf", "old", "official"), ("b.pdf", None, "sample")], "file string, title string, mode string")
    newer = spark.createDataFrame([("a.pdf", "new", "official")], "file string, title string, mode string")
    got = mf.with_defaults(mf.merged(raw, newer), {"title": "untitled", "tier": "D"})
    assert {tuple(r) for r in got.select("file", "title", "mode", "tier").collect()} == {("a.pdf", "new", "official", "D"), ("b.pdf", "untitled", "sample", "D")}
    assert [r.file for r in mf.merged(raw, newer, mode="sample").collect()] == ["b.pdf"]
    files = spark.createDataFrame([("a.pdf",), ("x/new_file-1.pdf",)], "file string")
    assert [tuple(r) for r in mf.drafts(files, raw).collect()] == [("x/new_file-1.pdf", "New File 1", True)]
    assert spark.range(1).select(mf.cache_name(F.lit("a" * 64), "p1")).first()[0] == "a" * 16 + "-p1"
