"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives every document a posterior over domains.
Document rates r >= 0 are fitted so that the expected domain totals sum_i r_i * tokens_i * posterior_i meet target
totals: least squares, each domain weighted by the inverse of its tokens, solved by projected gradient descent in the
metric of tokens. From r = 1 each step subtracts posterior . residual and cuts at 0, so a document's rate is a fold
over the residuals so far: an iteration is one aggregation over the written posteriors, of which only one number a
domain reaches the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drawn, table, words_of, written

#: Hash buckets of words, labelled documents to learn from (shared equally by the domains), and the words that a
#: posterior counts as seen.
BUCKETS, SAMPLE, EVIDENCE = 2048, 4000, 12
#: Domains with a model of their own; all rarer ones share the domain REST, which has a target like any other.
DOMAINS, REST = 64, "(rest)"
#: Steps after which a fit ends at the latest, the tolerance of a total, the least change of a step that goes on, and
#: steps after which rates are written.
ROUNDS, TOLERANCE, STALL, WRITE = 48, 1e-3, 1e-6, 16
#: Exponent that flattens the domains' shares of tokens, where targets aren't given.
TEMPER = 0.7


def _bucket(word: Column) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(BUCKETS)) + 1).cast("int")


def _numbers(values: list[float]) -> Column:
    """A constant array, as one literal after constant folding."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit_domains(labelled: DataFrame, id_col: str, text_col: str, domain_col: str) -> dict[str, tuple[float, list[float]]]:
    """Log prior and log probability of each bucket, by domain in order of name, REST last.

    Priors count all labelled rows. Words are those of SAMPLE labelled rows, as many of each domain. Domains beyond
    the DOMAINS most frequent ones are one domain REST. Rows with a null domain teach nothing.
    """
    import math

    known = labelled.where(F.col(domain_col).isNotNull())
    top = known.groupBy(domain_col).count().orderBy(F.desc("count"), domain_col).limit(DOMAINS).collect()
    if not top:
        return {}
    names = sorted(r[domain_col] for r in top)
    named = F.when(F.col(domain_col).isin(*names), F.col(domain_col)).otherwise(REST)
    known = known.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), named.alias("domain"))
    sizes = {r[domain_col]: r["count"] for r in top}
    rest = known.where(F.col("domain") == REST).count() if len(top) == DOMAINS else 0
    if rest:
        names, sizes = [*names, REST], {**sizes, REST: rest}
    some = drawn(known, "domain", "id", sizes, max(1, SAMPLE // len(sizes)))
    words = some.select("domain", F.explode(words_of(F.col("text"))).alias("word"))
    counts = {(r["domain"], r["b"]): r["n"] for r in words.groupBy("domain", _bucket(F.col("word")).alias("b")).agg(F.count("*").alias("n")).collect()}
    rows, out = sum(sizes.values()), {}
    for d in names:
        own = [counts.get((d, b + 1), 0) for b in range(BUCKETS)]
        total = sum(own) + 0.5 * BUCKETS
        out[d] = (math.log(sizes[d] / rows), [math.log((n + 0.5) / total) for n in own])
    return out


def _posteriors(docs: DataFrame, model: dict[str, tuple[float, list[float]]], text_col: str) -> DataFrame:
    """Adds __tokens (long) and __p (array<double>, by domain name). Words beyond EVIDENCE lower each one's weight."""
    out = docs.withColumn("__buckets", F.transform(words_of(F.coalesce(text_col, F.lit(""))), _bucket))
    out = out.withColumn("__tokens", F.size("__buckets").cast("long"))
    weight = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.lit(1), F.col("__tokens")))

    def summed(values: list[float]) -> Column:
        return F.aggregate("__buckets", F.lit(0.0), lambda a, b: a + F.element_at(_numbers(values), b))

    logits = [F.lit(prior) + weight * summed(values) for prior, values in model.values()]
    out = out.withColumn("__logits", F.array(*logits)).withColumn("__top", F.array_max("__logits"))
    out = out.withColumn("__e", F.transform("__logits", lambda x: F.exp(x - F.col("__top"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("__p", F.transform("__e", lambda x: x / total)).drop("__buckets", "__logits", "__top", "__e")


def _rate(steps: list[list[float]]) -> Column:
    """A document's rate after projected steps along the given residuals, from __r0."""
    if not steps:
        return F.col("__r0")
    dot = lambda v: F.aggregate(F.zip_with("__p", v, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    moves = F.array(*[F.array(*map(F.lit, v)) for v in steps])
    return F.aggregate(moves, F.col("__r0"), lambda r, v: F.greatest(F.lit(0.0), r - dot(v)))


def levelled(totals: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    """Target totals in proportion to totals ** temper with the same sum: large domains shrink, small ones grow."""
    flat = {d: t**temper if t > 0 else 0.0 for d, t in totals.items()}
    whole = sum(flat.values())
    return {d: sum(totals.values()) * f / whole if whole else 0.0 for d, f in flat.items()}


class Mixture(NamedTuple):
    rows: DataFrame
    domains: list[str]
    targets: dict[str, float]
    totals: dict[str, float]  # expected tokens at the fitted rates
    steps: int
    met: bool  # every total is within the tolerance of its target


def tempered(totals: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    """Target totals in proportion to totals ** temper, scaled so that no domain has to shrink."""
    some = {d: t for d, t in totals.items() if t > 0}
    scale = max((t / t**temper for t in some.values()), default=1.0)
    return {d: scale * t**temper if t > 0 else 0.0 for d, t in totals.items()}


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    keep: list[str],
    targets: dict[str, float] | Callable[[dict[str, float]], dict[str, float]] = tempered,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
) -> Mixture:
    """rows: the columns `keep` of docs with tokens long, posterior array<double>, rate double, copies int.

    posterior follows the domains' order. targets gives expected tokens for every domain (ValueError where it misses
    one or names another), or maps the expected totals at rate 1 to them. copies is the rate rounded up or down by a
    hash of id and text, so that the expected number of copies is the rate; repeated rows get equal copies.

    Defined cases: a null or text without words has no tokens and the prior as posterior. Texts of any length are
    counted whole. Null domains teach nothing. Without labelled rows there are no domains and every rate is 1. Targets
    out of reach are met as closely as the weighted squares allow. Where a total isn't within the tolerance when the
    fit has settled, or after ROUNDS steps, `met` is false and a warning says so; `totals` has what was reached.
    Columns of docs outside keep aren't read; the four names above are replaced.
    """
    names = [c for c in keep if c not in ("tokens", "posterior", "rate", "copies")]
    model = fit_domains(labelled, id_col, text_col, domain_col)
    uniform = F.pmod(F.xxhash64(id_col, text_col, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    base = docs.select(*dict.fromkeys([*names, id_col, text_col])).withColumn("__u", uniform)
    if not model:
        base = base.withColumn("__tokens", F.size(words_of(F.coalesce(text_col, F.lit("")))).cast("long"))
        rated = base.withColumn("__p", F.array().cast("array<double>")).withColumn("__r", F.lit(1.0))
        domains, aim, reached, taken, met = [], {}, {}, 0, True
    else:
        posteriors = _posteriors(base, model, text_col).withColumn("__r0", F.lit(1.0))
        scored = written(posteriors.select(*names, "__u", "__tokens", "__p", "__r0"), "posteriors")
        domains = list(model)

        def totals(rate: Column) -> list[float]:
            mass = F.col("__tokens") * F.col("__r")
            sums = [F.sum(mass * F.get("__p", F.lit(i))).alias(f"d{i}") for i in range(len(domains))]
            row = scored.select("__p", "__tokens", rate.alias("__r")).agg(*sums).first()
            return [x or 0.0 for x in row]

        start = totals(F.lit(1.0))
        goal = targets(dict(zip(domains, start))) if callable(targets) else targets
        if set(goal) != set(domains):
            raise ValueError(f"targets name {sorted(goal)}; the domains are {domains}")
        goal = [float(goal[d]) for d in domains]
        scale = [max(g, s, 1.0) for g, s in zip(goal, start)]
        steps: list[list[float]] = []
        now, taken, moved = start, 0, 1.0
        while not (met := all(abs(a - g) <= TOLERANCE * c for a, g, c in zip(now, goal, scale))) and moved > STALL and taken < ROUNDS:
            steps.append([(a - g) / s if s > 0 else 0.0 for a, g, s in zip(now, goal, start)])
            before, now, taken = now, totals(_rate(steps)), taken + 1
            moved = max(abs(a - b) / c for a, b, c in zip(now, before, scale))
            if len(steps) == WRITE:
                scored = written(scored.withColumn("__r0", _rate(steps)), "rates")
                steps = []
        rated = scored.withColumn("__r", _rate(steps))
        aim, reached = dict(zip(domains, goal)), dict(zip(domains, now))
        if not met:
            warnings.warn(f"after {taken} steps the totals are {reached} and not the targets {aim}", stacklevel=2)
    floor = F.floor("__r")
    copies = (floor + F.when(F.col("__u") < F.col("__r") - floor, 1).otherwise(0)).cast("int")
    out = rated.select(
        *names, F.col("__tokens").alias("tokens"), F.col("__p").alias("posterior"), F.col("__r").alias("rate"), copies.alias("copies")
    )
    return Mixture(out, domains, aim, reached, taken, met)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the table labels covers, with their language as domain; labels serves as a list of ids."""
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(covered, "doc_id", "left_semi")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as domains, levelled: the largest one shrinks, the sum of tokens stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing_rates(docs, labelled_documents(spark, sf_dir), ["doc_id"], levelled).rows
