"""Micro-batch cleaning of arriving review files (T9 + T12 on a file stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recolens.functions.rating import normalize_rating
from recolens.operators.lexicon import Lexicons, preprocess


def cleaned(stream: DataFrame, text_col: str, score_col: str | None = None,
            lex: Lexicons | None = None) -> DataFrame:
    """Row-local transformation shared by batch and stream: no state, so each
    micro-batch is independent and exactly-once comes from the file sink."""
    out = stream.withColumn("clean_text", preprocess(F.col(text_col), lex))
    if score_col:
        out = out.withColumn("rating_clean", normalize_rating(F.col(score_col)))
    return out


def clean_review_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                        checkpoint_location: str, text_col: str, score_col: str | None = None,
                        lex: Lexicons | None = None, fmt: str = "parquet",
                        max_files_per_trigger: int = 100) -> StreamingQuery:
    """Clean every new file of ``source_dir`` into ``sink_dir``; returns the
    started query (``availableNow``: processes what is there, then stops).
    ``checkpoint_location`` must be on shared storage in a cluster."""
    src = (spark.readStream.schema(schema).format(fmt)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))
    return (cleaned(src, text_col, score_col, lex).writeStream
            .format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_location)
            .outputMode("append").trigger(availableNow=True).start())
