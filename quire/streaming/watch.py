"""File events as a Structured Streaming source.

``watch_corpus`` streams every new file below a root (recursive; directories never appear).
Spark's file source emits a path once: a file rewritten in place is not seen again. For
modification events use ``changed_files``: a batch job comparing a fresh listing with the
previous one on (path, modificationTime, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def watch_corpus(spark: SparkSession, root: str, glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(root)


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file now below ``root`` as the same events, as a batch."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of every file now below ``root`` (no content read)."""
    return read_files(spark, root, glob).select("path", "modificationTime", "length")


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, event) with event created / modified / deleted, from two listings (full outer join)."""
    p = previous.select("path", F.col("modificationTime").alias("p_mtime"), F.col("length").alias("p_len"))
    j = current.join(p, "path", "full")
    event = F.when(F.col("p_mtime").isNull(), F.lit("created")).when(F.col("modificationTime").isNull(), F.lit("deleted")).when(
        (F.col("modificationTime") != F.col("p_mtime")) | (F.col("length") != F.col("p_len")), F.lit("modified")
    )
    return j.select("path", "modificationTime", "length", event.alias("event")).where(F.col("event").isNotNull())
