"""Relational reads: filtered and faceted lists, counts per parent, alignment, islands, last writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_filter(df: DataFrame, terms: Sequence[str], columns: Sequence[str], most: int = 6) -> DataFrame:
    """Rows in which every term (the first `most`) occurs in one of the columns, whatever its case."""
    for term in list(terms)[:most]:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
        df = df.where(hit)
    return df


def narrowed(df: DataFrame, equal: dict[str, object] | None = None, least: dict[str, object] | None = None, most: dict[str, object] | None = None) -> DataFrame:
    """Rows that satisfy every given condition, by column: a value to equal, a least or a greatest one. A value of None
    asks for nothing; a row without a value fails each condition on it."""
    for values, test in ((equal, lambda c, v: c == v), (least, lambda c, v: c >= v), (most, lambda c, v: c <= v)):
        for name, value in (values or {}).items():
            if value is not None:
                df = df.where(test(F.col(name), F.lit(value)))
    return df


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 20) -> DataFrame:
    """One page (from 1) of at most 100 rows in an order that ends with a unique key."""
    size = min(size, 100)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(df: DataFrame, first: str, second: str, most: int | None = None) -> DataFrame:
    """Counts by (first, second) and by second alone under the same filter, in one scan; `level` tells which.

    With `most`, only so many pairs are listed, the largest ones, as a filter shows them.
    """
    both = df.groupingSets([[F.col(first), F.col(second)], [F.col(second)]], first, second).agg(
        F.grouping(first).alias("level"), F.count("*").alias("n")
    )
    out = both.select(first, second, F.when(F.col("level") == 1, "second").otherwise("both").alias("level"), "n")
    if most is None:
        return out
    pairs = out.where("level = 'both'").orderBy(F.desc("n"), first, second).limit(most)
    return pairs.unionByName(out.where("level = 'second'"))


def typeahead(df: DataFrame, column: str, typed: str, tie: str, k: int = 8) -> DataFrame:
    """The k best rows that contain what is typed: those that begin with it first, then the shortest."""
    low = F.lower(column)
    begins = (~low.startswith(typed.lower())).cast("int")
    return df.where(low.contains(typed.lower())).orderBy(begins, F.length(column), column, tie).limit(k)


def child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """parents with a count column for each child table (name: (table, its key)), 0 where there is none."""
    out = parents
    for name, (table, foreign) in children.items():
        counts = table.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def orphans(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null references have none by definition and aren't listed."""
    return children.where(F.col(foreign).isNotNull()).join(parents, children[foreign] == parents[key], "left_anti")


def aligned(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, a, b, side): values of two tables side by side, the last row of a repeated key winning."""
    last = lambda d, name: d.groupBy(key).agg(F.max_by(value, order).alias(name), F.lit(True).alias(f"has_{name}"))
    both = last(a, "a").join(last(b, "b"), key, "full")
    side = F.when(F.col("has_a") & F.col("has_b"), "both").when(F.col("has_a"), "a").otherwise("b")
    return both.select(key, "a", "b", side.alias("side"))


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """group, island, value, n: runs of adjacent rows of equal value."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w))
    return numbered.groupBy(*group, "island").agg(F.first(value).alias(value), F.count("*").alias("n"))


def last_write(df: DataFrame, key: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """One row a key with each column's value of the highest seq."""
    return df.groupBy(key).agg(*[F.max_by(c, seq).alias(c) for c in columns])


def preferred(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def union_override(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of several manifests by key; a later source overrides an earlier one."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("__priority", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return preferred(out, [key], [F.desc("__priority")]).drop("__priority")
