"""Sinks: versioned tables with a pointer, requirement lists as CSV, reports as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIREMENT_COLUMNS = ("standard", "clause", "heading", "modality", "topic", "sentence", "page", "source")


def publish(df: DataFrame, root: str, version: str) -> None:
    """Write a version of a table and then append its name to the pointers, so that readers always find a whole one.

    One writer at a time; readers take the pointer of the highest number.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    try:
        number = _pointer(spark, root)["number"] + 1
    except AnalysisException:  # the first version
        number = 1
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/current")


_POINTER = "number long, version string"


def _pointer(spark: SparkSession, root: str):
    return spark.read.schema(_POINTER).parquet(f"{root}/current").agg(F.max(F.struct("number", "version")).alias("p")).first()["p"]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version."""
    return spark.read.parquet(f"{root}/versions/{_pointer(spark, root)['version']}")


def write_requirements(df: DataFrame, path: str) -> None:
    """CSV with the eight columns of the list, in that order, missing ones empty."""
    empty = F.lit(None).cast("string")
    out = df.select(*[F.col(c).cast("string") if c in df.columns else empty.alias(c) for c in REQUIREMENT_COLUMNS])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(rows: DataFrame, group: str, counts: dict[str, str], path: str) -> None:
    """JSON lines: for each group and in all (group null), how many rows satisfy each named condition."""
    rows.rollup(group).agg(F.count("*").alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()]).write.mode("overwrite").json(path)


def write_sheets(lines: DataFrame, path: str) -> None:
    """The sheets of present.requirement_sheet(): a folder a standard, its lines in order in one file."""
    dealt = lines.repartition("slug").sortWithinPartitions("slug", "ord").select("slug", "line")
    dealt.write.mode("overwrite").partitionBy("slug").text(path)
