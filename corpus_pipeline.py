"""Corpus pipeline: documents to packed training sequences, stage by stage.

1. toxicity: documents that the tagger predicts toxic go;
2. line_dedup: later similar lines leave the texts, documents stay;
3. near_duplicates: one row of each class of similar texts stays;
4. secrets: secrets in texts are masked, documents stay;
5. packing: the remaining texts become packed sequence pieces.

All but the last stage return the columns of documents.  Stages cannot be
expressed in SQL (trained models, tokenizer), so there is no oracle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.llm import line_dedup, lsh_forest, packing, secrets_forest, toxicity
from recolens.llm.frames import LAST_ID, unpacked, whole_rows, written

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic (rows without an id are judged by text alone)."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    return toxicity.filter_clean(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later similar lines from the texts."""
    return line_dedup.without_later_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of similar texts: the smallest id, a null id last,
    then the smallest text hash.  Of rows that repeat that id and text, one stays.
    Texts without a word are in no class and stay."""
    classes = lsh_forest.row_classes(docs).where("label is not null")
    place = [F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "th"]
    places = written(classes.select("label", F.col("doc_id").isNull().alias("last"), *place)
                     .groupBy("label", "last", "id", "th").agg(F.count("*").alias("n")), "duplicate-places")
    first = places.groupBy("label").agg(F.min(F.struct("last", "id", "th")).alias("first"), F.sum("n").alias("all"))
    gone = written(places.join(first.where("`all` > 1"), "label")
                   .select("last", "id", "th", (F.struct("last", "id", "th") == F.col("first")).alias("kept"), "n")
                   .where("not kept or n > 1").drop("n"), "duplicates")
    keys = ["last", "id", "th"]
    small = F.broadcast if gone.count() <= lsh_forest.BROADCAST_ROWS else (lambda df: df)
    rows = (whole_rows(docs).withColumn("last", F.col("row.doc_id").isNull())
            .withColumn("th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    alone = rows.join(small(gone), keys, "left_anti").select("row")
    one = (rows.join(small(gone.where("kept").drop("kept")), keys, "left_semi")
           .groupBy(*keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return unpacked(alone.unionByName(one), docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return secrets_forest.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.piece_digests(packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicate_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
