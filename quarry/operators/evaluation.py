"""Retrieval metrics: ranks of expected hits, recall, reciprocal rank, rates, percentiles, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded half to even; null where whole is 0."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole, digits))


def hit_ranks(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank): best rank within k of an expected (qid, id) pair; null where none is found."""
    near = results.where(F.col("rank") <= k).join(expected, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return expected.select("qid").distinct().join(near, "qid", "left")


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """One row: n, recall_at_5, mrr_at_10, hit_at_1 over (qid, rank)."""
    rank = F.col("rank")
    share = lambda c: F.bround(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    return ranks.agg(
        F.count("*").alias("n"), share(rank <= 5).alias("recall_at_5"),
        F.bround(F.avg(F.when(rank <= 10, 1.0 / rank).otherwise(0.0)), 3).alias("mrr_at_10"), share(rank <= 1).alias("hit_at_1"),
    )


def nearest_rank(values: DataFrame, group: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles by nearest rank: the value at index p/100 * (n - 1), rounded half to even.

    Distinct values are counted first and the counts accumulated, so a large group isn't gathered in one array.
    """
    from pyspark.sql.window import Window

    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*group)
    upto = F.sum("c").over(whole.orderBy(value))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(whole))
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("n") - 1), 0)
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}")
    return placed.groupBy(*group).agg(*[pick(p) for p in percents])


def threshold_sweep(scores: DataFrame, extra: tuple[float, ...] = (-8.0, -6.0, -4.0, -2.0, 0.0), digits: int = 2) -> DataFrame:
    """(threshold, refusal, false_refusal, score) for each candidate threshold over (score, answerable).

    A question is refused where its score is under the threshold. Thresholds are the rounded scores and a few fixed
    ones. Scores are counted by the least rounded number above them, so that what is summed up in order has as many rows
    as the scores have rounded values, not as there are scores.
    """
    from pyspark.sql.window import Window

    spark = scores.sparkSession
    # The rounded value is the nearest whole number of steps, on doubles as SQL's round_even; no zero is negative.
    unit = F.lit(10.0**digits)
    whole = lambda x: F.rint(x * unit) / unit + F.lit(0.0)
    near, step = whole(F.col("score")), 10.0**-digits
    rows = scores.select(F.when(F.col("score") < near, near).otherwise(whole(near + step)).alias("above"), near.alias("near"), "answerable")
    fixed = spark.createDataFrame([(x,) for x in extra], "t double")
    thresholds = rows.select(F.col("near").alias("t")).union(fixed).distinct()
    counted = rows.groupBy("above").agg(
        F.sum(F.when(F.col("answerable"), 0).otherwise(1)).alias("bad"), F.sum(F.when(F.col("answerable"), 1).otherwise(0)).alias("good")
    )
    # Thresholds sort behind equal counts, so that the running sums hold what is strictly below.
    line = counted.select(F.col("above").alias("at"), F.lit(-1).alias("kind"), "bad", "good").union(
        thresholds.select("t", F.lit(0), F.lit(0), F.lit(0))
    )
    before = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    summed = line.select(
        "at", "kind", F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("refused"), F.coalesce(F.sum("good").over(before), F.lit(0)).alias("lost")
    )
    totals = counted.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    out = summed.where("kind = 0").crossJoin(F.broadcast(totals)).select(
        F.col("at").alias("threshold"), F.try_divide("refused", "all_bad").alias("refusal"), F.try_divide("lost", "all_good").alias("false_refusal")
    )
    miss = F.col("false_refusal")
    return out.withColumn("score", F.col("refusal") - 2 * F.greatest(F.lit(0.0), miss - 0.1) - 0.5 * miss)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the best score; the smallest threshold among equals."""
    return swept.orderBy(F.desc("score"), "threshold").limit(1)


def expected_ranks(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank): best rank within k of a passage (qid, rank, slug, number, path) of an expected document (qid, slug,
    clause): the clause itself, one below it, or a path that begins with it; any clause where none is named."""
    clause = F.col("clause")
    hit = clause.isNull() | (F.col("number") == clause) | F.col("number").startswith(F.concat(clause, F.lit("."))) | F.col("path").startswith(F.concat(clause, F.lit(" ")))
    met = results.where(F.col("rank") <= k).join(expected, ["qid", "slug"]).where(hit).groupBy("qid").agg(F.min("rank").alias("rank"))
    return expected.select("qid").distinct().join(met, "qid", "left")


def fact_hits(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, facts, hits): how many of a question's facts (qid, fact) its answer (qid, text) holds, whatever the case."""
    found = F.coalesce(F.lower("text").contains(F.lower("fact")), F.lit(False))
    return facts.join(answers, "qid", "left").groupBy("qid").agg(F.count("*").alias("facts"), F.count_if(found).alias("hits"))


def judged(refuse: Column, refused: Column, any_answer: Column, number_hit: Column, doc: Column, wanted: Column, avoided: Column) -> Column:
    """Whether an everyday question was handled well. number_hit is null where no number is expected; wanted and
    avoided are words of the first source's title, wanted null where none is."""
    low = F.lower(F.coalesce(doc, F.lit("")))
    source = F.exists(wanted, lambda w: low.contains(w)) & ~F.coalesce(F.exists(avoided, lambda w: low.contains(w)), F.lit(False))
    return (
        F.when(refuse, refused).when(refused, F.lit(False)).when(any_answer, F.lit(True)).when(number_hit.isNotNull(), number_hit)
        .otherwise(F.coalesce(source, F.lit(False)))
    )
