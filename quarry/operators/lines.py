"""Lines of paged documents: repeated headers and footers, noise, metadata; clause numbers and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.cleaning import is_gazette_noise, is_page_number, is_watermark, repeat_key
from quarry.tables import sorted_join, written


def repeated_keys(lines: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, key) of lines on at least half of a document's pages (two at least); keys of one character don't count."""
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    keys = (
        lines.where(F.trim(text) != "").select(doc, page, repeat_key(F.col(text)).alias("key")).distinct()
        .groupBy(doc, "key").agg(F.count("*").alias("n"))
    )
    enough = F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.5))
    return keys.join(pages, doc).where((F.col("pages") >= 2) & enough & (F.length("key") > 1)).select(doc, "key")


def stripped(lines: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """lines with `removed`: repeated lines, page numbers, watermarks and boilerplate."""
    again = repeated_keys(lines, doc, page, text).withColumn("__again", F.lit(True))
    marked = lines.withColumn("key", repeat_key(F.col(text))).join(again, [doc, "key"], "left")
    line = F.col(text)
    noise = is_page_number(line) | is_watermark(line) | is_gazette_noise(line)
    return marked.withColumn("removed", F.coalesce(F.col("__again"), F.lit(False)) | noise).drop("__again", "key")


def body_style(lines: DataFrame, doc: str = "doc_id", size: str = "size", text: str = "text") -> DataFrame:
    """(doc, body_size): the font size of most characters; the smallest among equals."""
    sums = lines.groupBy(doc, size).agg(F.sum(F.length(text)).alias("n"))
    return sums.groupBy(doc).agg(F.max_by(size, F.struct("n", -F.col(size))).alias("body_size"))


def numbered_again(clauses: DataFrame, doc: str, number: str, order: str) -> DataFrame:
    """Clause numbers made unique in a document: the nth repeat becomes "number (n)"."""
    nth = F.row_number().over(Window.partitionBy(doc, number).orderBy(order))
    again = F.when(nth > 1, F.concat(F.col(number), F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col(number))
    return clauses.withColumn("unique_number", again)


def clause_paths(clauses: DataFrame, doc: str, node: str, parent: str, label: Column) -> DataFrame:
    """(doc, node, path, level): labels of a clause and its ancestors, joined by " › ", however deep the tree.

    Each round doubles how far up a path reaches, so n levels take log n joins. Nodes whose parent is missing are
    roots. Rows that are still open after as many rounds as the number of nodes allows are in a cycle: ValueError.
    """
    nodes = clauses.select(doc, node, parent, label.alias("path"))
    known = nodes.select(doc, F.col(node).alias(parent), F.lit(True).alias("__has"))
    rooted = nodes.join(sorted_join(known), [doc, parent], "left")
    paths = rooted.select(doc, node, F.when(F.col("__has"), F.col(parent)).alias("__up"), "path", F.lit(1).alias("level"))
    most, reach = None, 1
    while True:
        paths = written(paths, "clause-paths")
        most = paths.count() if most is None else most
        if not paths.where("__up is not null").limit(1).count():
            return paths.select(doc, node, "path", "level")
        if reach > 2 * most:
            raise ValueError("clauses that are their own ancestors")
        above = paths.select(doc, F.col(node).alias("__up"), F.col("__up").alias("__next"), F.col("path").alias("__head"), F.col("level").alias("__more"))
        paths = paths.join(sorted_join(above), [doc, "__up"], "left").select(
            doc, node, F.col("__next").alias("__up"), F.concat(F.coalesce(F.concat("__head", F.lit(" › ")), F.lit("")), "path").alias("path"),
            (F.col("level") + F.coalesce("__more", F.lit(0))).alias("level"),
        )
        reach *= 2
