"""Spark session helpers.

On a cluster the session is supplied by the caller; these helpers only fill in
settings that are *unset* (tests, bench, local runs).  Lineage cuts use the
shared folder named by ``spark.checkpoint.dir``; a local scratch folder is
only created when nothing is configured (local mode).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "recolens", driver_memory: str = "8g") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app_name)
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or int(cpus))))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Read from the session; only when unset *and* the master is local (tests,
    local runs) a scratch folder is created and registered.  On a cluster an
    unset folder is an error rather than a silent machine-local fallback.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...); "
                           "a machine-local folder does not survive executor loss")
    local = tempfile.mkdtemp(prefix="recolens-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when their action ends; otherwise they stay until
    the driver collects its garbage.  What later steps read must be a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def removed_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder below the shared checkpoint folder whose tables have no readers left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable lineage cut: ``checkpoint()`` into the shared checkpoint dir.

    Survives executor loss (unlike local checkpoints or caches)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Lineage cut through a Parquet table below the shared checkpoint folder, or at ``folder``:
    for large frames, as it is compressed by column where ``checkpoint()`` writes rows as they
    are, later readers take only their columns and the shuffle files of making it go with it."""
    path = folder or scratch_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                   shuffle_expansion: float = 1.0, min_partitions: int | None = None,
                   override: bool = False) -> dict:
    """Runtime SQL settings sized for ``input_bytes`` of input.

    * ``spark.sql.files.maxPartitionBytes`` = 128 MiB: scan tasks stay small
      enough to hold a decoded split comfortably in executor memory;
    * ``spark.sql.shuffle.partitions`` = shuffle volume / target size, at least
      the cluster's cores (an upper bound: AQE coalesces small partitions
      towards ``advisoryPartitionSizeInBytes``);
    * skew handling: a partition 5x the median and above 256 MiB is split.
    Values set explicitly at session start are left alone unless ``override``."""
    cores = spark.sparkContext.defaultParallelism
    parts = max(min_partitions or cores, int(input_bytes * shuffle_expansion / target_partition_bytes))
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }
    applied = {}
    for k, v in wanted.items():
        if not spark.conf.isModifiable(k):
            continue
        current = spark.sparkContext.getConf().get(k, None)
        if current is None or override:
            spark.conf.set(k, v)
            applied[k] = v
    return applied
