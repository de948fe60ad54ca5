"""Derived inputs built from the driver tables (Spark side). Each has a SQL twin in
``quire.plans.sqltext`` or in the query module that uses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import table
from quire.session import spread


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(doc_id, path, content) := documents with a path per source/lang."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.col("text").alias("content"))


# Fixed value: the fixture search text (a repeated term and a term with negative idf).
FIXED_QUERY = "elle para ingre elle the"


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, text) := benchmark items plus the fixed text as query -1."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fixed = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit(FIXED_QUERY).alias("text"))
    return bench.unionByName(fixed)
