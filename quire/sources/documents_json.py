"""Document collections as JSON: a fixed schema, JSON-lines on write, arrays or lines on read.

A file that holds one JSON array is read by many tasks (``read_json_array``): the text source cuts the
file into byte ranges and each range into fragments that end at a closing brace, wherever that is.
Whether a fragment begins inside a string, how deep it lies and which element it belongs to are
running sums over the fragments before it: quotes, then braces and brackets outside strings, then
braces that close an element. A sum runs within each range and over the ranges' totals, so a file
of any length is never in one task; only the fragments of one element meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.ranges import ranged, with_sum_before

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("chunk_size", T.IntegerType()),
    ]
)


def read_documents_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read documents with the fixed schema (no inference). ``multiline=True`` reads files that
    hold one JSON array (or pretty-printed objects), each by one task; ``read_json_array`` reads
    files of any size that hold one array."""
    return spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE").json(path)


def write_documents_json(df: DataFrame, path: str) -> None:
    df.select([f.name for f in DOCUMENT_SCHEMA.fields]).write.mode("overwrite").json(path)


def _deeper(text: Column) -> Column:
    """Opening less closing braces and brackets."""
    without = lambda marks: F.char_length(F.translate(text, marks, ""))
    return (without("}]") - without("{[")).cast("long")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """The objects of files that hold one JSON array of objects each, whatever their layout. Elements
    that are no objects are passed over; an object that does not fit ``schema`` gives nulls, as the
    permissive mode of the JSON source does; an empty array gives no rows."""
    text = ranged(spark.read.option("lineSep", "}"), path)
    # without escapes every quote opens or closes a string; the pieces between quotes alternate
    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    outside = lambda start: F.array_join(F.filter("pieces", lambda _, i: i % 2 == start), " ")
    marks = text.withColumn("pieces", pieces).select(
        "file", "range", "seq", (F.size("pieces") - 1).cast("long").alias("quotes"),
        _deeper(outside(0)).alias("from_outside"), _deeper(outside(1)).alias("from_inside"),
    )
    marks = with_sum_before(marks, F.col("quotes"), "quotes_before")
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the brace that ends the fragment is no text
    own = F.when(F.col("quotes_before") % 2 == 0, F.col("from_outside")).otherwise(F.col("from_inside"))
    change = own - F.when(closes, 1).otherwise(0)
    marks = with_sum_before(marks.select("file", "range", "seq", change.alias("change"), closes.alias("closes")), F.col("change"), "depth")
    ends = F.col("closes") & (F.col("depth") + F.col("change") == 1)
    marks = with_sum_before(marks.select("file", "range", "seq", ends.alias("ends")), F.col("ends").cast("long"), "element")
    parts = text.join(marks, ["file", "range", "seq"]).groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("range", "seq", "value"))).alias("parts"), F.max("ends").alias("whole")
    )
    joined = F.concat(F.array_join(F.col("parts.value"), "}"), F.lit("}"))
    objects = parts.filter("whole").select(joined.alias("text")).select(F.from_json(F.substring("text", F.instr("text", "{"), F.char_length("text")), schema).alias("d"))
    return objects.select("d.*")
