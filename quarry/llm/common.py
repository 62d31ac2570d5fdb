"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from quarry.tables import shared_dir, written  # noqa: F401  operators take them from here

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(rows: DataFrame, group: str, id_col: str, counts: dict, each: int) -> DataFrame:
    """`each` rows of every group at most (all of a smaller one), drawn by a hash of the id, with their place __rank.

    counts gives the groups' sizes. Three times the expected share passes a test of the hash and is then ranked, so
    neither a group nor the table is sorted whole.
    """
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * each / n))])
    draw = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < F.coalesce(F.element_at(share, F.col(group)), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(id_col, F.lit("sample")), id_col))
    return some.withColumn("__rank", rank).where(F.col("__rank") <= each)


def crc32_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo; null where the column is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def fold_ascii(column: Column) -> Column:
    """Lower-case A-Z and nothing else; plain lower() where the text is ASCII, as it is much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )


def words_of(text: Column) -> Column:
    """The runs of non-blank characters; an empty array where there are none (text must not be null)."""
    bare = F.trim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS_CLASS}]+"))


def sliced(batch, text_at: int, rows: int, most: int):
    """Slices of a record batch with their texts (null as empty): `rows` rows and about `most` characters at most."""
    start, held, texts = 0, 0, []
    column = batch.column(text_at)
    for i in range(batch.num_rows):
        text = column[i].as_py() or ""
        if texts and (len(texts) >= rows or held + len(text) > most):
            yield batch.slice(start, i - start), texts
            start, held, texts = i, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield batch.slice(start), texts


def map_texts(docs: DataFrame, keep: list[str], text_col: str, fields: list[StructField], func, rows: int = 512, most: int = 1 << 22) -> DataFrame:
    """Arrow-batched map over texts: func(list of texts, null as empty) gives a dict of columns by field name.

    Batches are cut into slices of at most `rows` rows and about `most` characters (one text at least), so that a task
    works on few texts at a time.
    """
    schema = StructType([docs.schema[c] for c in keep] + fields)
    names = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        types = {f.name: f.type for f in arrow}
        for batch in batches:
            for part, texts in sliced(batch, len(keep), rows, most):
                found = func(texts)
                columns = [part.column(i).cast(types[c]) for i, c in enumerate(keep)]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, types[n]) for n in names for x in (found[n],)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
