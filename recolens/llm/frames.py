"""Shared input handling of the operators in this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.session import checkpoint_dir, removed_folder, shuffles_dropped  # noqa: F401 - for the operators

#: Words of a text: runs of anything but space and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns of any name cannot clash.

    A null text is the empty text; a null id stays null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


LAST_ID = (1 << 63) - 1


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, id, text): all columns as one struct, so that helper columns cannot
    clash with them; a null id is the last id."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("text"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder, or in a
    ``folder`` of the caller's there.

    Unlike a checkpoint, the table keeps column pruning for later readers."""
    path = shared_path(df.sparkSession, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
