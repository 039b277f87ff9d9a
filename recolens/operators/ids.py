"""Dense integer ids for arbitrary keys, without a single-partition window.

A global ``dense_rank()`` would move every key into one task.  Instead the
distinct keys are range-sorted (a distributed sort), each row takes its
position inside its partition from ``monotonically_increasing_id`` (partition
index in the upper bits, row index in the lower 33 bits), and per-partition
offsets come from a per-partition count whose size is the number of
partitions (a proven broadcast bound).  The nondeterministic ids are frozen by
a reliable checkpoint before they are used, so a recomputed task cannot
renumber.  Ids follow key order (0-based); numeric keys may instead pass
through unchanged, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolens.session import cut_lineage


def dense_ids(df: DataFrame, key: str, id_col: str = "dense_id",
              order_col: str | None = None) -> DataFrame:
    """``(key, id_col)`` for the distinct non-null keys of ``df``.

    Ids follow key order, or - with ``order_col`` - the order of each key's
    first appearance (smallest ``order_col``; ties by key), which is the
    reference's factorize order when ``order_col`` is the row position."""
    base = df.where(F.col(key).isNotNull())
    if order_col is None:
        keys = base.select(key).distinct().orderBy(key)
    else:
        keys = (base.groupBy(key).agg(F.min(order_col).alias("__first"))
                .orderBy("__first", key).select(key))
    keys = (keys.withColumn("__pid", F.spark_partition_id())
            .withColumn("__mono", F.monotonically_increasing_id()))
    keys = cut_lineage(keys)
    counts = keys.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return (keys.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
            .select(key, (F.col("__off") + F.col("__mono")
                          - F.shiftleft(F.col("__pid").cast("long"), 33)).cast("int").alias(id_col)))


def encode(df: DataFrame, key: str, id_col: str, numeric_pass_through: bool = True) -> DataFrame:
    """Attach an int id for ``key``: numeric keys are cast, others densely coded."""
    dtype = dict(df.dtypes)[key]
    if numeric_pass_through and dtype in ("int", "bigint", "smallint", "tinyint"):
        return df.withColumn(id_col, F.col(key).cast("int"))
    return df.join(dense_ids(df, key, id_col), key)
