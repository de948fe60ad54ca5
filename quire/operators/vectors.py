"""Path-keyed vector index maintenance: membership, upsert, remove, stats.

The index is a table ``(path, embedding)`` with one row per path — the key lives in the
row, never in an ordinal side list. Every operator is a join (semi / anti / left / full
outer) plus aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def dimension(index: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row, one column: the size that all vectors of ``index`` share; mixed sizes fail."""
    size = F.size(F.col(vec))
    sizes = index.where(F.col(vec).isNotNull()).agg(F.min(size).alias("least"), F.max(size).alias("most"))
    mixed = F.raise_error(F.lit("vectors of different sizes in one index"))
    return sizes.select(F.when(F.col("least").eqNullSafe(F.col("most")), F.col("most")).otherwise(mixed).alias("dimension"))


def has_embedding(files: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """files + ``has_embedding`` flag (left join on the distinct index keys)."""
    keys = index.select(key).distinct().withColumn("has_embedding", F.lit(True))
    return files.join(keys, key, "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def missing_embeddings(files: DataFrame, index: DataFrame, key: str = "path", force: str | None = None) -> DataFrame:
    """Files that need an embedding: not in the index (anti join), plus forced ones."""
    todo = files.join(index.select(key), key, "left_anti")
    if force is None:
        return todo
    return todo.unionByName(files.where(F.col(force)).join(index.select(key).distinct(), key, "left_semi"))


def vector_upsert(index: DataFrame, batch: DataFrame, key: str = "path", force: str = "force") -> DataFrame:
    """Full outer join of the index with a batch ``(path, embedding, force)``.

    action: ``created`` (new path), ``recreated`` (existing, forced), ``skipped`` (existing,
    not forced), ``unchanged`` (index row not in the batch). The embedding column is the
    resulting index content.
    """
    old = index.select(key, F.col("embedding").alias("old_embedding"))
    new = batch.select(key, F.col("embedding").alias("new_embedding"), F.coalesce(F.col(force), F.lit(False)).alias("_force"))
    j = old.join(new, key, "full_outer")
    in_old = F.col("old_embedding").isNotNull()
    in_new = F.col("new_embedding").isNotNull() | F.col("_force").isNotNull()
    action = (
        F.when(~in_new, F.lit("unchanged"))
        .when(~in_old, F.lit("created"))
        .when(F.col("_force"), F.lit("recreated"))
        .otherwise(F.lit("skipped"))
    )
    emb = F.when(action.isin("created", "recreated"), F.col("new_embedding")).otherwise(F.col("old_embedding"))
    return j.select(key, action.alias("action"), emb.alias("embedding"))


def vector_remove(index: DataFrame, requests: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Returns (per-request result with action removed/skipped, remaining index)."""
    wanted = requests.select(key).distinct()
    present = index.select(key).join(wanted, key).distinct().withColumn("_present", F.lit(True))
    result = requests.select(key).join(present, key, "left").select(
        key, F.when(F.col("_present"), F.lit("removed")).otherwise(F.lit("skipped")).alias("action")
    )
    remaining = index.join(requests.select(key), key, "left_anti")
    return result, remaining


def vector_stats(index: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """One row: total_vectors, existing_files, missing_files, dimension (max length)."""
    exists = files.select(key).distinct().withColumn("_exists", F.lit(True))
    j = index.join(exists, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.count_if(F.col("_exists").isNotNull()).alias("existing_files"),
        F.count_if(F.col("_exists").isNull()).alias("missing_files"),
        F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("dimension"),
    )


def cache_status(stats: DataFrame) -> DataFrame:
    """empty (no vectors) / active (some indexed file exists) / stale (none exists)."""
    status = (
        F.when(F.col("total_vectors") == 0, F.lit("empty"))
        .when(F.col("existing_files") > 0, F.lit("active"))
        .otherwise(F.lit("stale"))
    )
    return stats.select(
        F.col("total_vectors").alias("cached_files"), "existing_files", "missing_files", status.alias("status")
    )
