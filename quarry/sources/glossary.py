"""A glossary as a table: synonyms, product wording, keywords and protected terms, by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROTECTED = "do_not_translate"


def entries(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, section, pos, key, terms of glossary texts: lines "section:", and below one "  key: [a, b]" or "  - term".

    Comments and blank lines don't count; a key or term may be in quotes. A term of a list has no key. Lines of other
    forms are no entries.
    """
    lines = texts.select(*keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line")).where(r"line rlike '\\S' and not line rlike '^\\s*#'")
    line = F.col("line")
    section = F.when(line.rlike(r"^[\w-]+:\s*$"), F.regexp_extract(line, r"^([\w-]+):", 1))
    order = Window.partitionBy(*keep).orderBy("pos")
    held = lines.withColumn("section", F.last(section, ignorenulls=True).over(order)).where(section.isNull())
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), "^[\"'](.*)[\"']$", "$1"))
    pair = r"^\s+(.+?):\s+\[(.*)\]\s*$"
    keyed = line.rlike(pair)
    terms = F.filter(F.transform(F.split(F.regexp_extract(line, pair, 2), ","), bare), lambda x: x != "")
    item = F.array(bare(F.regexp_extract(line, r"^\s+-\s+(.+)$", 1)))
    found = held.where(keyed | line.rlike(r"^\s+-\s+\S"))
    return found.select(*keep, "section", "pos", F.when(keyed, bare(F.regexp_extract(line, pair, 1))).alias("key"), F.when(keyed, terms).otherwise(item).alias("terms"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, pos, key, terms) of glossary files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return entries(files, ["path"])


def protected(glossary: DataFrame) -> DataFrame:
    """The terms that stay as they are when an answer is translated."""
    return glossary.where(F.col("section") == PROTECTED).select(F.explode("terms").alias("term")).distinct()


def synonyms(glossary: DataFrame, section: str) -> DataFrame:
    """(key, term) of a section, in lower-case keys."""
    return glossary.where(F.col("section") == section).select(F.lower("key").alias("key"), F.explode("terms").alias("term")).distinct()


def has_key(text: Column, key: Column) -> Column:
    """Whether a text has the key as words, the last with an s or without; case and marks don't count."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))
    blank = F.lit(" ")
    words = F.concat(blank, plain(text), blank)
    return F.contains(words, F.concat(blank, plain(key), blank)) | F.contains(words, F.concat(blank, plain(key), F.lit("s ")))
