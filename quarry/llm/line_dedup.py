"""Line dedup over a whole corpus, in DataFrame operations only.

Lines are exploded, normalised and hashed, and hashes and positions are written; the distinct documents of each hash
are counted; lines over the threshold are dropped and each document is reassembled by line position. Only hashes and
positions travel through the counting shuffles; whole texts are shuffled once, to meet the positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WS, fold_ascii, table, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return fold_ascii(F.trim(line, F.lit(WS)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of docs, with the text reassembled from the lines that stay, and n_lines, n_dropped (long).

    A line's key is the line without surrounding white space and with A-Z lower-cased. Keys of at least min_chars
    code points that min_docs documents or more hold lose all their lines, except in the document of the largest id.

    Defined cases: a null or empty text is one empty line and comes back empty. A document is an id: rows that repeat
    one count once, and all rows of the largest id keep the line. Rows without an id count as one document together,
    which never is the largest. Texts of any length are split whole, in one row. Extra columns pass through; n_lines
    and n_dropped replace columns of these names. An empty table gives an empty result. Keys are told apart by 96
    bits of hash.
    """
    spare = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The input's columns travel as one struct, so that no name of theirs meets one of these.
    keyed = docs.select(
        F.struct(*spare).alias("row"), F.xxhash64(id_col, text_col).alias("k1"), F.hash(text_col, F.lit(7), id_col).alias("k2")
    )
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    lines = keyed.select("k1", "k2", F.col("row")[id_col].alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    held = written(
        lines.select("k1", "k2", "id", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("k1", "k2", "id", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
        .groupBy("h1", "h2", "k1", "k2")
        .agg(F.first("id").alias("id"), F.collect_set("pos").alias("at")),
        "held-lines",
    )
    common = (
        held.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("keep"))
        .where(F.col("docs") >= min_docs)
    )
    # Joined by a struct, so that both sides are dealt anew and Spark may split the rows of a very common line.
    lost = (
        held.withColumn("h", F.struct("h1", "h2"))
        .join(common.select(F.struct("h1", "h2").alias("h"), "keep"), "h")
        .where(F.col("id").isNull() | F.col("keep").isNull() | (F.col("id") != F.col("keep")))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("at")).alias("lost"))
    )
    split = keyed.join(lost, ["k1", "k2"], "left").withColumn("lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("lost", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return split.select(
        *[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in spare],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(stay)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH split_docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
exploded AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split_docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded),
common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keep AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
