"""Parquet table access for the driver tables (``<dir>/<name>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; projections/filters applied later are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every table as a temp view (for SQL-form plans)."""
    for n in names:
        load_table(spark, sf_dir, n).createOrReplaceTempView(n)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (text cleaning, tokenising) at least the
    cluster's parallelism.  A scan has one task per file split / row group;
    when that is fewer than ``min_partitions`` (default: default parallelism)
    the rows are spread round-robin once.  On a large table the scan already
    has far more splits than cores, so this adds no shuffle there."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
