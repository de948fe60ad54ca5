"""Session helpers: build a local session for tests/bench, resolve the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parallelism(spark: SparkSession, default: int = 8) -> int:
    """Cores available to the application (falls back to ``default`` where the session has
    no SparkContext, e.g. a Spark Connect client)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.default.parallelism", str(default)))


def app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return str(id(spark))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` names storage every executor can reach. Where it is unset, a
    single-process session (``local[N]``) gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    except Exception:  # noqa: BLE001  (no SparkContext on this client: nothing to set)
        pass
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over the cores if its scan fills fewer tasks than there are cores (a table
    of one row group is one task, however long). Which tasks have rows is counted without reading a
    column; a table of many files is not even counted. The rows are the same either way."""
    cores = parallelism(df.sparkSession)
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(2 * cores, key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: what follows reads
    the result instead of computing it again, after a lost executor too, and the planner knows
    its real size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
