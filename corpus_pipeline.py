"""The corpus pipeline: quality, lines, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.line_dedup import line_dedup
from quarry.llm.mixing import mixing_rates
from quarry.llm.near_dedup import near_dedup
from quarry.llm.pieces import DEFAULT_MODEL, encode_texts, load
from quarry.llm.quality_classifier import learn_rule, quality_scores


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names of this module's own for the columns that the stages don't read, so that none is replaced."""
    return docs.select([F.col(c) if c in ("doc_id", "text") else F.col(c).alias(f"column {i}") for i, c in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from those of _plain()."""
    return rows.select([F.col(plain).alias(c) for plain, c in zip(_plain(docs).columns, docs.columns, strict=True)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from labelled rows outside the held-out third."""
    learn, fold = learn_rule()
    plain = _plain(docs)
    scored = quality_scores(plain, table(spark, sf_dir, "labels"), learn, fold, plain.columns)
    return _named(scored.where("predicted = 1"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five documents or more share, but for one of them; n_chars follows the text."""
    kept = _named(line_dedup(_plain(docs)), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that languages come closer to equal shares of words; no language shrinks.

    Learns languages from the documents that the table labels covers. A document comes as often as its rate says,
    rounded by a hash; rates are 1 or more up to the fit's tolerance, and every document stays at least once.
    """
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", "text", "lang").join(covered, "doc_id", "left_semi")
    plain = _plain(docs)
    mixed = mixing_rates(plain, labelled, plain.columns)
    copies = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies")))
    return _named(mixed.rows.withColumn("copy", F.explode(copies)), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text. Tasks take half as much text at a
    time as the operator alone does, as the workers of the stages before still hold memory."""
    return encode_texts(docs, load(DEFAULT_MODEL), ["doc_id"], most=1 << 21)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("mixing", mixing),
    ("SentencePiece", tokens),
]

#: SQL can't express the classifier, the mixing and the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.split()[0].lower()}")
    return docs
