"""Matching of questions with official product names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.retrieval import product_score, stem


def stems(text: Column) -> Column:
    """Distinct stems of the words of a text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: stem(w)))


def product_probe(questions: DataFrame, products: DataFrame, name: str, id_col: str, k: int = 3) -> DataFrame:
    """(qid, id, name, score, rank): the k best products of each question (qid, words, extra, context: stems).

    Products and questions meet on a shared stem (of the words or the extra ones), so no pair without one is scored.
    Ties go to the largest name and id, as whole tuples compare.
    """
    named = products.select(id_col, name, stems(F.col(name)).alias("__stems"))
    by_stem = named.withColumn("__stem", F.explode("__stems"))
    asked = questions.withColumn("__stem", F.explode(F.array_union("words", "extra")))
    pairs = by_stem.join(asked, "__stem").drop("__stem").dropDuplicates(["qid", id_col])
    score = product_score(F.col("__stems"), F.col("words"), F.col("extra"), F.col("context"))
    scored = pairs.withColumn("score", score).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.desc(name), F.desc(id_col))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("qid", id_col, name, "score", "rank")


def suggestions(questions: DataFrame, products: DataFrame, name: str, k: int = 2) -> DataFrame:
    """(qid, name): up to k distinct product names that share a stem of five letters or more with a question."""
    named = products.select(name).distinct().withColumn("__stem", F.explode(stems(F.col(name)))).where(F.length("__stem") >= 5)
    asked = questions.withColumn("__stem", F.explode("words"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(name))
    found = named.join(asked, "__stem").select("qid", name).distinct()
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("qid", name)
