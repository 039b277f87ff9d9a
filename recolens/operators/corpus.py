"""Item corpora: ordered review bags (A1), catalog <- bag join (J1, P11),
corpus length profile (A7).

``review_bag`` returns the reference's row-per-item string.  Its output row
necessarily holds all of one item's cleaned reviews, so it is meant for
reporting and serving; it is built in two levels (chunks, then items) so the
work of a hot item is spread, and the TF-IDF path (``tfidf.segment_terms``)
never builds it - it counts terms per review segment instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered_concat(df: DataFrame, keys: list[str], order_col: str, text_col: str,
                    out_col: str) -> DataFrame:
    pairs = F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))
    return (df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(pairs)).alias("__b"))
            .select(*keys, F.array_join(F.transform("__b", lambda s: s["t"]), " ").alias(out_col)))


def review_bag(reviews: DataFrame, text_col: str = "text", order_col: str = "seg_order",
               item_col: str = "item_id", out_col: str = "bag",
               chunk_rows: int = 1024) -> DataFrame:
    """A1: per item, the review texts joined by single spaces in ``order_col``
    order (explicit order, so bigrams across reviews are deterministic).

    Two levels, so a hot item's reviews are not sorted and joined in one
    group: reviews are first concatenated within chunks of ``chunk_rows``
    consecutive order values, then the (few) chunk strings per item.  The
    chunk number is monotonic in the order, so the result equals one ordered
    concatenation."""
    chunk = F.floor(F.col(order_col).cast("double") / F.lit(float(chunk_rows))).cast("long")
    level1 = _ordered_concat(
        reviews.where(F.col(item_col).isNotNull()).withColumn("__chunk", chunk),
        [item_col, "__chunk"], order_col, text_col, "__part")
    return _ordered_concat(level1, [item_col], "__chunk", "__part", out_col)


def corpus(catalog: DataFrame, bags: DataFrame, cleaned_text: Column,
           item_col: str = "item_id") -> DataFrame:
    """J1 + P11: ``cleaned item text + ' ' + bag`` (missing bag -> '')."""
    return (catalog.join(bags, item_col, "left")
            .select(item_col, F.concat(cleaned_text, F.lit(" "),
                                       F.coalesce(F.col("bag"), F.lit(""))).alias("corpus")))


def length_profile(df: DataFrame, text_col: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max
    of the text lengths, in one aggregate."""
    n = F.length(F.col(text_col))
    return df.select(n.alias("len")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("len"), 6).alias("mean"),
        F.round(F.stddev_samp("len"), 6).alias("std"),
        F.min("len").cast("long").alias("min"),
        F.round(F.percentile(F.col("len"), F.lit(0.25)), 6).alias("p25"),
        F.round(F.percentile(F.col("len"), F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(F.col("len"), F.lit(0.75)), 6).alias("p75"),
        F.max("len").cast("long").alias("max"))
