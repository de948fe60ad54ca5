"""Operation history with before-images: snapshot, rollback, retention, stats.

``history(operation_id, type, original_path, backup_path, snapshot STRUCT<content, hash, size>, ts)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import utf16_length

# Fixed value: history entries older than this many hours are dropped.
RETENTION_HOURS = 24


def snapshot(requests: DataFrame, files: DataFrame, now: Column, path: str = "path") -> DataFrame:
    """Before-image per request path: content, md5, UTF-16 size, timestamp; missing -> error."""
    # hash and size once per file, before the join (a file can be requested many times)
    f = files.select(F.col("path").alias(path), F.col("content").alias("_content"), F.md5("content").alias("_hash"),
                     utf16_length(F.col("content")).alias("_size"), F.lit(True).alias("_exists"))
    j = requests.join(f, path, "left")
    ok = F.col("_exists").isNotNull()
    snap = F.when(ok, F.struct(F.col("_content").alias("content"), F.col("_hash").alias("hash"),
                               F.col("_size").alias("size"), now.alias("timestamp")))
    return j.select(
        *[c for c in requests.columns],
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("file does not exist: "), F.col(path))).alias("error"),
        snap.alias("snapshot"),
    )


def rollback(requests: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(operation_id) -> (per request result, history without rolled-back rows).
    Restores ``snapshot.content`` to ``original_path``; unknown id or missing snapshot -> error.
    Later edits to the same file are not undone. ``ts`` and the numeric ``seq`` order operations."""
    h = history.select("operation_id", "type", "original_path", "snapshot", "ts", "seq")
    j = requests.select("operation_id").join(h, "operation_id", "left")
    error = F.when(F.col("type").isNull(), F.concat(F.lit("operation not found: "), F.col("operation_id"))).when(
        F.col("snapshot").isNull(), F.concat(F.lit("no snapshot for operation "), F.col("operation_id"))
    )
    ok = error.isNull()
    result = j.select(
        "operation_id",
        ok.alias("success"),
        error.alias("error"),
        F.when(ok, F.col("original_path")).alias("restored_file"),
        F.when(ok, F.col("type")).alias("original_operation"),
        F.when(ok, F.col("snapshot.content")).alias("restored_content"),
        "ts",
        "seq",
    )
    done = result.where("success").select("operation_id")
    return result, history.join(done, "operation_id", "left_anti")


def restore(files: DataFrame, rollback_result: DataFrame) -> DataFrame:
    """Apply restored contents to the file table: of several rolled-back operations on a path the
    latest, by time and then sequence number, wins. A restored path that is gone comes back."""
    latest = F.max_by(F.col("restored_content"), F.struct("ts", "seq"))
    r = rollback_result.where("success").groupBy(F.col("restored_file").alias("path")).agg(latest.alias("_restored"))
    j = files.join(r, "path", "full")
    return j.withColumn("content", F.coalesce("_restored", "content")).drop("_restored")


def record(history: DataFrame, requests: DataFrame, files: DataFrame) -> DataFrame:
    """``history`` with one row for each request (operation_id, type, path, ts, seq) on a file that
    exists: the file's content now is the before-image."""
    snap = snapshot(requests, files, F.col("ts")).where("success")
    rows = snap.select(
        "operation_id", "type", F.col("path").alias("original_path"), F.concat("path", F.lit(".backup."), F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("backup_path"),
        F.struct(F.col("snapshot.content").alias("content"), F.col("snapshot.hash").alias("hash"), F.col("snapshot.size").alias("size")).alias("snapshot"), "ts", "seq",
    )
    return rows if history is None else history.unionByName(rows)


def retention(history: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> tuple[DataFrame, DataFrame]:
    """(one row: cleaned_count, remaining_count, cutoff; surviving history)."""
    cutoff = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    old = F.col("ts") < cutoff
    report = history.agg(F.count_if(old).alias("cleaned_count"), F.count_if(~old).alias("remaining_count")).withColumn(
        "cutoff", cutoff
    )
    return report, history.where(~old)


def stats(history: DataFrame, last_n: int = 10) -> DataFrame:
    """The last ``last_n`` operations (insertion order) with totals: total_operations,
    oldest / newest timestamp, has_backup per listed operation."""
    totals = history.agg(
        F.count(F.lit(1)).alias("total_operations"), F.min("ts").alias("oldest_operation"), F.max("ts").alias("newest_operation")
    )
    # a top-k (TakeOrderedAndProject: per-partition top-k, then a merge of k rows per partition)
    recent = history.select("operation_id", "type", "ts", "seq", F.col("backup_path").isNotNull().alias("has_backup"))
    recent = recent.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(last_n)
    last = recent.withColumn("recent_rank", F.row_number().over(Window.orderBy(F.col("ts").desc(), F.col("seq").desc())))
    t = totals.select(F.struct("total_operations", "oldest_operation", "newest_operation")).scalar()  # one subquery
    return last.withColumn("_t", t).select(*last.columns, "_t.*")
