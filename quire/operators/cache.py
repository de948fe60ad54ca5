"""Content-keyed result cache kept as a table.

``cache(cache_type, key, payload, size_bytes, created_at)`` — an append-only log of writes;
the live cache is the latest write per (cache_type, key), found with a partial+final
``max_by`` aggregate (a hot key collapses map-side, it never lands whole in one task).
TTLs come from a small config table; ``now`` is always a parameter (column or scalar
subquery), never the wall clock, so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cache types and their time-to-live in days.
CACHE_TTL_DAYS = [("embeddings", 7), ("reranking", 1), ("llm_responses", 3)]


def cache_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CACHE_TTL_DAYS, "cache_type string, ttl_days int")


def content_key(text: Column) -> Column:
    return F.md5(text)


def request_key(*fields: Column) -> Column:
    """sha256 of the JSON of a request struct (all fields, not a prefix of them)."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def live_entries(log: DataFrame) -> DataFrame:
    """Latest write per (cache_type, key); ties on created_at go to the later log row."""
    latest = F.max_by(F.struct("payload", "size_bytes", "created_at"), F.struct("created_at", "seq"))
    return log.groupBy("cache_type", "key").agg(latest.alias("e")).select("cache_type", "key", "e.*")


def _ttl_seconds(config: DataFrame) -> DataFrame:
    return config.select("cache_type", (F.col("ttl_days") * 86400).cast("long").alias("ttl_s"))


def _age_seconds(now: Column, created: Column) -> Column:
    # a difference of wall-clock readings; no time-zone conversion involved
    return F.timestamp_diff("MICROSECOND", created, now) / 1e6


def lookup(requests: DataFrame, entries: DataFrame, config: DataFrame, now: Column, force: str | None = None) -> DataFrame:
    """Per request (cache_type, key): status hit / expired / miss / bypassed.
    A hit needs ``now - created_at < ttl`` (strict); a type without TTL never expires."""
    j = requests.join(entries, ["cache_type", "key"], "left").join(_ttl_seconds(config), "cache_type", "left")
    age = _age_seconds(now, F.col("created_at"))
    status = F.when(F.col("created_at").isNull(), F.lit("miss"))
    if force is not None:
        status = status.when(F.col(force), F.lit("bypassed"))
    status = status.when(F.col("ttl_s").isNull() | (age < F.col("ttl_s")), F.lit("hit")).otherwise(F.lit("expired"))
    return j.withColumn("age_seconds", age).withColumn("status", status)


def cache_aside(requests: DataFrame, cached: DataFrame, compute, id_col: str = "doc_id") -> DataFrame:
    """requests(id, key, text) + cached(key, value) -> (id, key, value, source cache/generated).

    Requests are classified on (id, key) alone; texts are read only for one request of each
    missing key, so identical texts are computed once and copies never meet. ``compute(df)``
    turns (key, text) into (key, value)."""
    slim = requests.select(id_col, "key")
    misses = slim.join(cached.select("key"), "key", "left_anti").groupBy("key").agg(F.min(id_col).alias(id_col))
    texts = requests.select(id_col, "key", "text").join(misses, [id_col, "key"], "left_semi").select("key", "text")
    known = cached.select("key", "value", F.lit("cache").alias("source"))
    generated = compute(texts).select("key", "value", F.lit("generated").alias("source"))
    return slim.join(known.unionByName(generated), "key").select(id_col, "key", "value", "source")


def _per_type(entries: DataFrame) -> DataFrame:
    """Entries aggregated per type first (partial + final aggregate): everything after this
    joins tables with one row per cache type."""
    return entries.groupBy("cache_type").agg(
        F.count("key").alias("_n"), F.sum("size_bytes").alias("_bytes"), F.min("created_at").alias("_oldest"), F.max("created_at").alias("_newest")
    )


def _mb(c):
    return F.round(F.coalesce(c, F.lit(0)) / 1024 / 1024, 2)


def stats(entries: DataFrame, config: DataFrame) -> DataFrame:
    """Per configured type (listed even when empty) plus a total row (cache_type 'all'):
    files_count, total_size_mb (2 dp), oldest, newest, ttl_days."""
    j = config.join(_per_type(entries), "cache_type", "left")
    by_type = j.select(
        "cache_type",
        F.coalesce("_n", F.lit(0)).cast("long").alias("files_count"),
        _mb(F.col("_bytes")).alias("total_size_mb"),
        F.col("_oldest").alias("oldest"),
        F.col("_newest").alias("newest"),
        "ttl_days",
    )
    total = j.agg(
        F.lit("all").alias("cache_type"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("files_count"),
        _mb(F.sum("_bytes")).alias("total_size_mb"),
        F.min("_oldest").alias("oldest"),
        F.max("_newest").alias("newest"),
        F.lit(None).cast("int").alias("ttl_days"),
    )
    return by_type.unionByName(total)


def clear(entries: DataFrame, config: DataFrame, cache_type: str = "all") -> tuple[DataFrame, DataFrame]:
    """Returns (per cleared type: files_deleted, space_freed_mb; surviving entries)."""
    types = config.select("cache_type") if cache_type == "all" else config.where(F.col("cache_type") == cache_type).select("cache_type")
    report = types.join(_per_type(entries), "cache_type", "left").select(
        "cache_type", F.coalesce("_n", F.lit(0)).cast("long").alias("files_deleted"), _mb(F.col("_bytes")).alias("space_freed_mb")
    )
    survivors = entries.join(types, "cache_type", "left_anti")
    return report, survivors
