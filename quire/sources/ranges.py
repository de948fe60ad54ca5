"""Running sums over the pieces of large files that many tasks read by byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import stored


def ranged(reader, path: str) -> DataFrame:
    """(file, size, range, seq, value): what the text source ``reader`` splits off, with the byte range that
    it was read from and its order within; written, so that later steps see one numbering."""
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("seq"), "value",
    )
    return stored(rows, "ranges")


def with_sum_before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier pieces of the file: a sum within each range and one
    over the ranges' totals, so no file is ever in one task."""
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_value", value)
    totals = pieces.groupBy("file", "range").agg(F.sum("_value").alias("_total"))
    base = F.coalesce(F.sum("_total").over(earlier("file").orderBy("range")), F.lit(0))
    totals = totals.select("file", "range", base.alias("_base"))
    inside = F.coalesce(F.sum("_value").over(earlier("file", "range").orderBy("seq")), F.lit(0))
    return stored(pieces.join(totals, ["file", "range"]).withColumn(name, F.col("_base") + inside).drop("_base", "_value"), "scan")
