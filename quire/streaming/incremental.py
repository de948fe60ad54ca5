"""Incremental chunk index maintained by a streaming query.

Each micro-batch of file records ``(path, content, version)`` keeps the latest version per path and
writes two tables under ``batch_id=<id>`` with dynamic partition overwrite: ``versions`` (path,
version), one row for every path of the batch, and ``chunks``, its token windows with the default
embedding and the same version. A replayed batch rewrites its own partitions only, so the sink is
idempotent. The live index is, per path, the chunks of its highest version (the later batch, if a
version comes twice): an emptied or deleted file (NULL content) has a version and no chunks, so it
drops out, and an old version that arrives late changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.embed import embed
from quire.operators.chunking import token_chunks


def file_records(file_events: DataFrame, decode_policy: str = "drop") -> DataFrame:
    """Adapt a ``watch_corpus`` stream (path, modificationTime, length, content bytes) to the
    record shape the index consumes: (path, content, version = modification time). Files that
    the policy drops have no record."""
    from quire.sources.corpus import decode

    text = decode(F.col("content"), decode_policy)
    return file_events.select("path", text.alias("content"), F.unix_micros("modificationTime").alias("version")).where(
        F.col("content").isNotNull()
    )


def change_records(spark: SparkSession, changes: DataFrame, root: str, now_version: int, decode_policy: str = "drop") -> DataFrame:
    """Records of ``changed_files`` below ``root``: created and modified files with their content
    now, deleted ones with NULL content at ``now_version``."""
    from quire.streaming.watch import read_files

    events = file_records(read_files(spark, root).join(changes.where("event <> 'deleted'").select("path"), "path", "left_semi"), decode_policy)
    gone = changes.where("event = 'deleted'").select("path", F.lit(None).cast("string").alias("content"), F.lit(now_version).cast("long").alias("version"))
    return events.unionByName(gone)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def index_batch(batch: DataFrame, batch_id: int, index_path: str, dim: int) -> None:
    newest = F.max_by(F.struct("content", "version"), "version").alias("f")
    latest = batch.select("path", "content", F.col("version").cast("long")).groupBy("path").agg(newest).select("path", "f.*")
    number = F.lit(int(batch_id)).cast("long").alias("batch_id")
    chunks = token_chunks(latest.where(F.col("content").isNotNull()), "content", keep=("path", "version"))
    _write(chunks.select("path", "version", "chunk_id", "text", embed(F.col("text"), dim).cast("array<float>").alias("embedding"), number), f"{index_path}/chunks")
    # written last: a path counts as indexed once its chunks are there
    _write(latest.select("path", "version", number), f"{index_path}/versions")


def start_incremental_index(
    stream: DataFrame, index_path: str, checkpoint: str, dim: int, available_now: bool = True
):
    """Start the streaming query; returns the StreamingQuery."""
    writer = stream.writeStream.foreachBatch(lambda df, bid: index_batch(df, bid, index_path, dim)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _current(spark: SparkSession, index_path: str) -> DataFrame:
    versions = spark.read.parquet(f"{index_path}/versions")
    return versions.groupBy("path").agg(F.max(F.struct("version", "batch_id")).alias("v")).select("path", "v.*")


def current_chunks(spark: SparkSession, index_path: str) -> DataFrame:
    """The live index: per path, only the chunks of its highest version."""
    chunks = spark.read.schema("path string, version long, chunk_id int, text string, embedding array<float>, batch_id long").parquet(f"{index_path}/chunks")
    return chunks.join(_current(spark, index_path), ["path", "version", "batch_id"], "left_semi")


def compact(spark: SparkSession, index_path: str, out_path: str) -> None:
    """Write the live view to ``out_path`` as one batch, versions included. Readers of the
    compacted copy no longer resolve versions over the whole history; streaming can continue
    into the compacted folder with batch ids above the one recorded here."""
    versions = _current(spark, index_path)
    top = versions.agg(F.max("batch_id")).first()[0]  # one number
    number = F.lit(top).cast("long")
    current_chunks(spark, index_path).withColumn("batch_id", number).write.mode("overwrite").partitionBy("batch_id").parquet(f"{out_path}/chunks")
    versions.withColumn("batch_id", number).write.mode("overwrite").partitionBy("batch_id").parquet(f"{out_path}/versions")
