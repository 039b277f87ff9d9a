"""Concept mapping onto the driver's tables.

| concept                | source                                                      |
| ---------------------- | ----------------------------------------------------------- |
| user / item / rating   | ``orders.o_custkey`` / ``lineitem.l_partkey`` / quantity / 5 |
| raw (dirty) score text | formatted from the same quantity, see ``raw_score``         |
| user display name      | ``customer.c_name``                                          |
| catalog                | ``part``: id, name, display name, text = name + brand + type |
| reviews (ordered)      | ``conversations``: conv_id = item, turn = order, role + text |
| text corpus            | ``documents.text``                                           |
| embedding table        | ``embeddings`` (vec_id taken as the item id)                 |
| free-text queries      | ``benchmark.text``                                           |

Every frame here is a lazy projection of a parquet scan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.sources.tables import load_table, spread


def raw_score(q2: F.Column, key: F.Column) -> F.Column:
    """A dirty score string for a rating of ``q2 / 10`` (``q2`` an integer),
    in one of the formats review sites produce: ``N/A``, a word, a comma
    decimal, ``x/10``, a dot decimal.  The format is chosen from the order key
    (every row is kept; the key only picks the format)."""
    whole = (q2 / 10).cast("long").cast("string")
    frac = (q2 % 10).cast("string")
    return (F.when(key % 7 == 0, F.lit("N/A"))
            .when(key % 13 == 0, F.lit("no score"))
            .when(key % 5 == 0, F.concat(whole, F.lit(","), frac))
            .when(key % 11 == 0, F.concat(whole, F.lit("."), frac, F.lit("/10")))
            .otherwise(F.concat(whole, F.lit("."), frac)))


RAW_SCORE_SQL = """CASE WHEN {k} % 7 = 0 THEN 'N/A'
  WHEN {k} % 13 = 0 THEN 'no score'
  WHEN {k} % 5 = 0 THEN CAST({q2} // 10 AS VARCHAR) || ',' || CAST({q2} % 10 AS VARCHAR)
  WHEN {k} % 11 = 0 THEN CAST({q2} // 10 AS VARCHAR) || '.' || CAST({q2} % 10 AS VARCHAR) || '/10'
  ELSE CAST({q2} // 10 AS VARCHAR) || '.' || CAST({q2} % 10 AS VARCHAR) END"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per purchase line: (user_id, item_id, rating, raw_score, l_orderkey, l_linenumber)."""
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    q2 = (F.col("l_quantity") * 2).cast("long")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    (F.col("l_quantity") / 5.0).alias("rating"),
                    raw_score(q2, F.col("l_orderkey")).alias("raw_score"),
                    "l_orderkey", "l_linenumber"))


INTERACTIONS_SQL = f"""SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity / 5.0 AS rating,
  {RAW_SCORE_SQL.format(k='l_orderkey', q2='CAST(l_quantity * 2 AS BIGINT)')} AS raw_score,
  l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, name, display_name, text).  ``name`` repeats across items (64
    values), ``display_name`` is unique per item, like a hotel's listed name."""
    return load_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("display_name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, seg_order, merged) - the merged text is every string column of
    the review row joined by spaces (P10), nulls as empty."""
    c = spread(load_table(spark, sf_dir, "conversations"))
    return c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("seg_order"),
                    F.concat_ws(" ", T.as_text(F.col("role")), T.as_text(F.col("text"))).alias("merged"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load_table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("item_id"), "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
