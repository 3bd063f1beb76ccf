"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on: UTC wall clock (timestamps are handled as
# TIMESTAMP_NTZ, but DuckDB/pandas comparisons assume UTC), AQE for runtime
# re-planning (partition coalescing, skew-join splitting, broadcast
# conversion from measured sizes).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "orderlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    ``master`` is only set when given, so a cluster launcher's choice wins.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the whole cluster
            b = b.config("spark.driver.memory", "16g")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    local master (tests) gets a fresh local folder and a cluster an error:
    executors could not share a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current and (not named or _plain(current).startswith(_plain(named).rstrip("/") + "/")):
        return named or current  # already set: no new sub-folder for every call
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="orderlens-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def _plain(path: str) -> str:
    """A path without ``file:`` and doubled slashes before it."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def scale_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for an input of ``input_bytes`` on
    ``total_cores`` cores: enough shuffle partitions that each holds about
    ``target_partition_bytes`` (at least 2 per core) — AQE then coalesces
    small ones to ``advisoryPartitionSizeInBytes`` and splits skewed ones;
    scan splits of 128 MB keep a task's input well inside executor memory.
    At 100 TB this gives 372,530 partitions of 256 MB; pass the bytes that
    reach a shuffle, which partial aggregation makes far fewer.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that is read more than once (fit, then
    apply): a reliable checkpoint in the shared ``spark.checkpoint.dir``.
    The result survives executor loss (files, not executor memory) and is
    not recomputed from the upstream joins."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
