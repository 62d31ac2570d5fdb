"""Incremental ingest: a stream over a folder that takes each content once, over any number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, glob: str = "*", a_batch: int | None = None) -> DataFrame:
    """A stream (path, content, sha256) of the files in a folder and those that come; a_batch bounds a batch's files."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if a_batch:
        reader = reader.option("maxFilesPerTrigger", a_batch)
    return reader.load(folder).select("path", "content", F.sha2("content", 256).alias("sha256"))


def rows(spark: SparkSession, folder: str, schema: StructType, text: Column, glob: str = "*", a_batch: int | None = None) -> DataFrame:
    """A stream of a Parquet folder's rows with sha256 of a text (null as empty)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if a_batch:
        reader = reader.option("maxFilesPerTrigger", a_batch)
    return reader.parquet(folder).withColumn("sha256", F.sha2(F.coalesce(text, F.lit("")), 256))


def ingested(stream: DataFrame, out: str, checkpoint: str, key: str = "sha256") -> DataFrame:
    """Takes what the stream has and out doesn't: rows of each key once, appended to the Parquet table `out`.

    The checkpoint holds the source's place and the seen keys, so a further run takes only what is new, and one after a
    failure goes on where the last whole batch ended: the sink's log makes a repeated batch replace its own files.
    """
    fresh = stream.dropDuplicates([key])
    query = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
