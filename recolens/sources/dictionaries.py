"""Dictionary text files as DataFrames.

Each line is stripped of white space (CRLF files included), blank lines are skipped, the line is split once on the
separator (a real tab by default); keys and values are trimmed; a line without
the separator becomes a key with an empty value; for a repeated key the later
line wins.  An absent path gives an empty frame with the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recolens.functions.text import WS

DICT_SCHEMA = StructType([StructField("key", StringType()), StructField("value", StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on the file system Spark itself would read ``path`` from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_dict(spark: SparkSession, path: str, sep: str | None = "\t") -> DataFrame:
    """``(key, value)`` per distinct key; ``sep=None`` reads a plain word list."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], DICT_SCHEMA)
    lines = (spark.read.text(path, wholetext=False)
             .select(_strip(F.col("value")).alias("line"),
                     F.monotonically_increasing_id().alias("line_no"))
             .where(F.col("line") != ""))
    if sep:
        has = F.instr("line", sep) > 0
        parts = F.split("line", _java_quote(sep), 2)
        kv = lines.select(
            F.when(has, _strip(parts[0])).otherwise(F.col("line")).alias("key"),
            F.when(has, _strip(parts[1])).otherwise(F.lit("")).alias("value"),
            "line_no")
    else:
        kv = lines.select(F.col("line").alias("key"), F.lit("").alias("value"), "line_no")
    # later line wins (max_by over the line number; ids increase with file order)
    return kv.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def _strip(c):
    """Python ``str.strip()``: Unicode white space incl. ``\r`` of CRLF files."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def _java_quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def dict_from_pairs(spark: SparkSession, pairs) -> DataFrame:
    """A small in-code dictionary as a frame (later pair wins)."""
    d = {}
    for k, v in pairs:
        d[k] = v
    return spark.createDataFrame(list(d.items()), DICT_SCHEMA)

