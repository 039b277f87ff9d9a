"""File sources and sinks.

* ``read_csv_safely``: CSV whose files may differ in encoding.  Every file is read as
  ISO-8859-1, which keeps each byte as one character; a first scan decides for each
  file which encoding its bytes allow (UTF-8 with or without a byte-order mark, then
  cp1258, then ISO-8859-1), a second one decodes its values so.  Vietnamese in cp1258
  writes tones as combining marks, so decoded values are composed (NFC).
* embeddings, recommendation tables and result tables are parquet/CSV
  directories written by the cluster (no driver-side files).
"""

from __future__ import annotations

import unicodedata
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, FloatType, LongType, StringType, StructField,
                               StructType)

from recolens.functions import text as T
from recolens.session import cut_lineage
from recolens.sources.dictionaries import path_exists

BOM = "\ufeff"
UTF8, CP1258, LATIN1 = "UTF-8", "cp1258", "ISO-8859-1"
ENCODINGS = (UTF8, CP1258, LATIN1)
RECS_SCHEMA = StructType([StructField("UserName", StringType()),
                          StructField("RecommendedHotel", StringType())])
EMBEDDING_SCHEMA = StructType([StructField("item_id", LongType()),
                               StructField("embedding", ArrayType(FloatType()))])


def _read_csv(spark: SparkSession, path: str, encoding: str, **options) -> DataFrame:
    opts = {"header": "true", "multiLine": "true", "escape": '"', "encoding": encoding}
    opts.update({k: str(v) for k, v in options.items()})
    df = spark.read.options(**opts).csv(path)
    if df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0][len(BOM):])
    return df


def cp1258_table() -> tuple[str, str, str]:
    """(bytes as characters, what cp1258 reads in them, bytes that it does not define)."""
    source, target, undefined = "", "", ""
    for code in range(0x80, 0x100):
        try:
            target += bytes([code]).decode("cp1258")
            source += chr(code)
        except UnicodeDecodeError:
            undefined += chr(code)
    return source, target, undefined


def _utf8(raw):
    """The UTF-8 text of a string of bytes, without a byte-order mark in front."""
    return F.regexp_replace(F.decode(F.encode(raw, LATIN1), UTF8), f"^{BOM}", "")


def _cp1258(raw):
    source, target, _ = cp1258_table()
    return T.nfc(F.translate(raw, source, target))


def _allows(raw, encoding: str):
    """Whether the bytes of a value are text in that encoding; null is."""
    if encoding == UTF8:
        ok = F.is_valid_utf8(F.encode(raw, LATIN1).cast("string"))
    elif encoding == CP1258:
        ok = ~raw.rlike(f"[{cp1258_table()[2]}]")
    else:
        ok = F.lit(True)
    return F.coalesce(ok, F.lit(True))


def _name(raw: str, encodings) -> str:
    """A header's name, by the first encoding that allows it."""
    for encoding in encodings:
        try:
            return unicodedata.normalize("NFC", raw.encode("latin-1").decode(encoding)).removeprefix(BOM)
        except UnicodeError:
            continue
    return raw


def file_encodings(spark: SparkSession, path: str, encodings=ENCODINGS, **options) -> DataFrame:
    """(file, encoding): the first of ``encodings`` that every value of the file allows,
    the last one without a check."""
    raw = _read_csv(spark, path, LATIN1, **options)
    texts = [F.col(f"`{f.name}`") for f in raw.schema.fields if isinstance(f.dataType, StringType)]
    checks = [reduce(lambda x, y: x & y, [_allows(c, e) for c in texts], F.lit(True)) for e in encodings[:-1]]
    found = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.lit(True).alias("any"), *(F.bool_and(c).alias(f"is{i}") for i, c in enumerate(checks)))
    kind = F.lit(encodings[-1])
    for i in reversed(range(len(checks))):
        kind = F.when(F.col(f"is{i}"), encodings[i]).otherwise(kind)
    return found.select("file", kind.alias("encoding"))


def read_csv_safely(spark: SparkSession, path: str, encodings=ENCODINGS, **options) -> DataFrame:
    """A CSV file or a folder of them, each file in the first of ``encodings`` that
    its bytes allow.  Names come from the first file's header; empty files are no files."""
    raw = _read_csv(spark, path, LATIN1, **options)
    names = [_name(c, encodings) for c in raw.columns]
    kinds = cut_lineage(file_encodings(spark, path, encodings, **options))       # one row a file
    used = {r.encoding for r in kinds.select("encoding").distinct().collect()}
    marked = raw.select("*", F.col("_metadata.file_path").alias("file of row"))
    if len(used) > 1:
        marked = marked.join(kinds.withColumnRenamed("file", "file of row"), "file of row")
    else:
        marked = marked.withColumn("encoding", F.lit(next(iter(used), encodings[-1])))

    def decoded(field):
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, StringType):
            return c
        out = c
        for encoding, read in ((CP1258, _cp1258), (UTF8, _utf8)):
            if encoding in used:
                out = F.when(F.col("encoding") == encoding, read(c)).otherwise(out)
        return out

    return marked.select(*(decoded(f).alias(n) for f, n in zip(raw.schema.fields, names)))


def save_embeddings(df: DataFrame, path: str, id_col: str = "item_id",
                    vec_col: str = "embedding") -> None:
    """S3: ``(item_id, embedding ARRAY<FLOAT>)`` as parquet."""
    (df.select(F.col(id_col).cast("long").alias("item_id"),
               F.col(vec_col).cast("array<float>").alias("embedding"))
     .write.mode("overwrite").parquet(path))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """S3 load; an absent table gives ``None`` (the method is then skipped, M11)."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def read_recommendations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The precomputed per-user recommendation table; absent -> empty frame
    with the fixed columns."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RECS_SCHEMA)
    if fmt == "csv":
        return _read_csv(spark, path, "UTF-8")
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                single_file: bool = False) -> None:
    """Result tables.  ``single_file`` is for small, bounded reports only
    (grid trials, summaries); large tables keep their partitioning."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def profile(df: DataFrame) -> DataFrame:
    """One-row profile ``(n_rows, n_cols, schema)``; the row count is a
    distributed count, the rest is metadata."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.lit(df.schema.simpleString()).alias("schema"))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """K7: first ``n`` rows (a preview; the limit is the feature)."""
    return df.limit(n)


def run_stamp() -> str:
    """``yyyyMMdd_HHmmss`` stamp for output names (UTC)."""
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
