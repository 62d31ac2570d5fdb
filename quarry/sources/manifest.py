"""Manifests of source files: reading, overriding, defaults, drafts for unknown files, parse caches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.relations import union_override


#: The columns of an entry.
ENTRY = (
    "file string, tier string, location string, standard_number string, title string, doc_type string, source_type string, source_url string, "
    "obtained_on string, status string, status_verified_on string, verification_status string, language string, synthetic boolean, needs_review boolean"
)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The entries of manifests in JSON lines, those of later paths overriding by file; lines without a file are none."""
    return merged(*[spark.read.schema(ENTRY).json(p).where("file is not null") for p in paths])


def merged(*manifests: DataFrame, mode: str | None = None, key: str = "file") -> DataFrame:
    """Rows of all manifests by file, later ones overriding; of one mode (official or sample) if it is given."""
    out = union_override(*manifests, key=key)
    return out.where(F.col("mode") == mode) if mode else out


def with_defaults(manifest: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing values filled in, column by column."""
    return manifest.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in manifest.columns else F.lit(v) for c, v in defaults.items()})


def drafts(files: DataFrame, manifest: DataFrame, key: str = "file") -> DataFrame:
    """Entries to review for files that no manifest names."""
    new = files.join(manifest.select(key), key, "left_anti").select(key)
    stem = F.regexp_replace(F.regexp_replace(F.col(key), r"^.*/", ""), r"\.[^.]*$", "")
    return new.withColumn("title", F.initcap(F.regexp_replace(stem, "[_-]+", " "))).withColumn("needs_review", F.lit(True))


def cache_name(sha256: Column, parser: str) -> Column:
    return F.concat(F.substring(sha256, 1, 16), F.lit(f"-{parser}"))


def front_matter(text: Column) -> Column:
    """struct(header, body) of a text that begins with a block between two --- lines; header is null without one."""
    parts = F.split(text, r"(?m)^---\s*$", 3)
    has = text.rlike(r"^---\s*\n") & (F.size(parts) == 3)
    return F.struct(F.when(has, F.trim(F.get(parts, F.lit(1)), F.lit(" \n"))).alias("header"), F.when(has, F.trim(F.get(parts, F.lit(2)), F.lit("\n"))).otherwise(text).alias("body"))


def header_value(header: Column, name: str) -> Column:
    """A scalar of a "name: value" header, without quotes; null where it is missing."""
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*?)\s*$", 1)
    return F.nullif(F.trim(value, F.lit("\"' ")), F.lit(""))


def mode(dataset: Column) -> Column:
    """official, or sample for sample and demo data."""
    return F.when(dataset.isin("sample", "demo"), "sample").otherwise("official")


def public_entries(pages: DataFrame, log: DataFrame, kinds: Mapping[str, tuple[str, str]], fallback: tuple[str, str]) -> DataFrame:
    """Manifest entries of the public pages (file, title, url, doc_type, language) that the fetch log (file, obtained_on)
    has: a PDF of guidance has a type of its own; kinds gives each type's tier and source type."""
    kind = F.coalesce("doc_type", F.lit("guidance_page"))
    kind = F.when((kind == "guidance_page") & F.lower("file").endswith(".pdf"), "guidance_pdf").otherwise(kind)
    of = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[i])]), F.col("doc_type")), F.lit(fallback[i]))
    last = log.groupBy("file").agg(F.max("obtained_on").alias("obtained_on"))
    return pages.withColumn("doc_type", kind).join(last, "file").select(
        "file", of(0).alias("tier"), F.lit("public").alias("location"), "title", "doc_type", of(1).alias("source_type"), F.col("url").alias("source_url"),
        "obtained_on", F.lit("current").alias("status"), F.col("obtained_on").alias("status_verified_on"), F.lit("verified").alias("verification_status"),
        F.coalesce("language", F.lit("en")).alias("language"), F.lit(False).alias("synthetic"), F.lit(False).alias("needs_review"),
    )


def sample_entries(documents: DataFrame) -> DataFrame:
    """Manifest entries of sample documents (file, text) by the header of each; those without a number are left out."""
    head = front_matter(F.col("text"))["header"]
    of = lambda name: header_value(F.col("head"), name)
    out = documents.select(F.regexp_replace("file", r"\.[^.]*$", ".pdf").alias("file"), head.alias("head")).where(of("number").isNotNull())
    return out.select(
        "file", F.lit("D").alias("tier"), F.lit("demo").alias("location"), of("number").alias("standard_number"), of("title").alias("title"),
        F.lit("synthetic_demo").alias("doc_type"), F.lit("sample").alias("source_type"), F.lit("unknown").alias("status"),
        F.lit("sample").alias("verification_status"), F.lit(True).alias("synthetic"), F.lit(False).alias("needs_review"),
    )


def save(manifest: DataFrame, path: str) -> None:
    """The entries as JSON lines in one file, by tier (a missing one last) and file. A manifest has a row a file of a
    folder, so it is small beside what it lists."""
    manifest.orderBy(F.coalesce("tier", F.lit("Z")), "file").coalesce(1).write.mode("overwrite").json(path)
