"""Persisted indexes as plain parquet tables.

BM25: ``postings`` and ``terms`` are partitioned by ``bucket = pmod(xxhash64(term), n)``
and sorted by term inside each file; n follows the size of the corpus. ``search_bm25_index``
takes the terms of the request, opens only their bucket directories, and pushes the terms into
the scan, where the sorted row groups prune. ``stats`` is one row (with the bucket count). Vectors: ``(path, embedding)``; an absent or unreadable index
reads as an empty table with the same schema. Every write goes to a fresh directory (a
version); a reader is given that directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from quire.operators import bm25
from quire.operators.bm25 import Bm25Index

#: Text bytes that one bucket of postings stands for.
BUCKET_BYTES = 64 << 20


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """Bucket count by corpus size: one scan of the text column's lengths."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size // BUCKET_BYTES))


def term_bucket(term, n_buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def _write_by_bucket(df: DataFrame, path: str, n_buckets: int) -> None:
    """Rebalance on the bucket before a partitioned write: adaptive execution splits a
    bucket that is larger than the advisory partition size over several writer tasks (a hot
    bucket is never one task) and merges small ones, so each bucket gets files of a sane
    size; every file is sorted by term (row-group min/max prune on term)."""
    out = df.withColumn("bucket", term_bucket(F.col("term"), n_buckets))
    out = out.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    out.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_bm25_index(index: Bm25Index, path: str, n_buckets: int) -> None:
    _write_by_bucket(index.postings, f"{path}/postings", n_buckets)
    _write_by_bucket(index.terms, f"{path}/terms", n_buckets)
    index.stats.withColumn("n_buckets", F.lit(n_buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def build_and_write_bm25_index(docs: DataFrame, path: str, n_buckets: int | None = None,
                               id_col: str = "doc_id", text_col: str = "text") -> None:
    """Build the index from documents with the postings written first: document frequencies
    and corpus statistics are then computed from the written postings (lineage cut at a
    stored table), so the corpus is tokenised only for the postings write."""
    spark = docs.sparkSession
    n_buckets = n_buckets or buckets_for(docs, text_col)
    postings = bm25.term_frequency(bm25.tokenized(docs, id_col, text_col))
    _write_by_bucket(postings, f"{path}/postings", n_buckets)
    stored = spark.read.parquet(f"{path}/postings")
    n_docs = docs.select(F.count(F.lit(1)))  # no tokenising: a row count of the source
    terms = bm25.document_frequency_idf(stored.drop("bucket"), n_docs)
    _write_by_bucket(terms, f"{path}/terms", n_buckets)
    n = n_docs.scalar()
    vocab = spark.read.parquet(f"{path}/terms").select(F.count(F.lit(1))).scalar()
    stats = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total_len")).select(
        n.alias("n_docs"),
        "total_len",
        F.when(n > 0, F.col("total_len") / n).otherwise(F.lit(0.0)).alias("avg_doc_len"),
        vocab.alias("vocab_size"),
        F.lit(n_buckets).alias("n_buckets"),
    )
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_bm25_index(spark: SparkSession, path: str) -> tuple[Bm25Index, DataFrame]:
    """(index, stats row with n_buckets)."""
    stats = spark.read.parquet(f"{path}/stats")
    postings = spark.read.parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/terms")
    return Bm25Index(postings, terms, stats.drop("n_buckets")), stats


VECTOR_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def write_vector_index(index: DataFrame, path: str) -> None:
    index.select("path", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(VECTOR_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], VECTOR_SCHEMA)


def append_cache(entries: DataFrame, path: str, batch: int) -> None:
    """Append one numbered batch of cache writes, partitioned by batch and type. Writing a batch
    again replaces what it wrote before, so a retried append leaves no second copy."""
    rows = entries.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cache_type").parquet(path)


def search_bm25_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    limit: int | None = bm25.DEFAULT_LIMIT,
    id_col: str = "query_id",
    text_col: str = "text",
) -> DataFrame:
    """BM25 search on a persisted index for a request batch.

    The request's terms (not the index) come to the driver: their buckets name the directories
    to list and read, the terms themselves are a pushed filter on the sorted files."""
    stats = spark.read.parquet(f"{path}/stats")
    n_buckets = stats.select("n_buckets").first()[0]
    qt = bm25.query_terms(queries, id_col, text_col).withColumn("bucket", term_bucket(F.col("term"), n_buckets))
    wanted = qt.select("bucket", "term").distinct().collect()
    empty = spark.createDataFrame([], "query_id long, doc_id long, bm25_score double, rank int")
    if not wanted:
        return empty
    glob = "{" + ",".join(str(b) for b in sorted({r["bucket"] for r in wanted})) + "}"
    named = F.col("term").isin(sorted(r["term"] for r in wanted))
    try:
        postings = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings/bucket={glob}").where(named)
        terms = spark.read.option("basePath", f"{path}/terms").parquet(f"{path}/terms/bucket={glob}").where(named)
    except AnalysisException:  # none of the query's buckets holds any term of the corpus
        return empty
    index = Bm25Index(postings, terms, stats.drop("n_buckets"))
    return bm25.score(index, qt, ["bucket", "term"], postings, terms, limit)
