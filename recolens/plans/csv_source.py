"""The reference's own inputs: a catalog CSV, a review CSV and dictionary files.

``load_review_tables`` follows the load path of the reference: encoding-safe
CSV read (S1), column names trimmed (P3) and renamed from synonyms (P1/P2),
description fallback (P6), required columns checked before any action (P5),
reviews without a reviewer dropped (P8).  It returns the three frames the
plans work on:

* catalog      (item_id, item_key, name, display_name, text)
* reviews      (item_id, seg_order, merged)   merged = all string columns (P10)
* interactions (user_id, item_id, raw_score, pos)

Item keys that are not integers are given dense ids in first-appearance order
(P13); users are reviewer names (Q23).  ``run`` then evaluates the content
methods and runs the ALS search, writing the result tables.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recolens.functions import columns as C
from recolens.functions import text as T
from recolens.functions.rating import normalize_rating
from recolens.operators import factor, ids, ranking
from recolens.operators.lexicon import Lexicons, collect_map, collect_set
from recolens.plans import evaluation as E
from recolens.session import cut_lineage
from recolens.sources.dictionaries import read_dict
from recolens.sources.files import read_csv_safely, run_stamp, write_table

# Column synonyms of the reference's loader.
CATALOG_SYNONYMS = {
    "Hotel_ID": ["hotel_id", "hotelid"], "Hotel_Name": ["hotel_name", "name"],
    "Hotel_Address": ["hotel_address", "address"], "Hotel_Description": ["hotel_description", "description"],
    "Image_URL": ["image_url", "image"], "Hotel_Rank": ["hotel_rank", "rank", "stars"],
    "Total_Score": ["total_score", "score"],
}
REVIEW_SYNONYMS = {"Reviewer_Name": ["reviewer_name", "user_name"], "Hotel_ID": ["hotel_id"]}
# Dictionary file names and separators.
DICTIONARY_FILES = {"teencode": ("teencode.txt", "\t"), "emoji": ("emojicon.txt", "\t"),
                    "stopwords": ("vietnamese-stopwords.txt", None), "wrong": ("wrong-word.txt", None),
                    "en_vi": ("english-vnmese.txt", "\t")}


def _roles(synonyms: dict[str, list[str]]) -> list[C.Role]:
    return [C.Role(name, tuple(labels)) for name, labels in synonyms.items()]


@dataclass
class ReviewTables:
    catalog: DataFrame
    reviews: DataFrame
    interactions: DataFrame


def _item_ids(catalog: DataFrame, key: str) -> DataFrame:
    """(key, item_id): integer keys pass through, others get dense ids."""
    if dict(catalog.dtypes)[key] in ("int", "bigint", "smallint", "tinyint"):
        return catalog.select(F.col(key).alias("__key"), F.col(key).cast("long").alias("item_id")).distinct()
    return (ids.dense_ids(catalog.select(F.col(key).cast("string").alias("__key"), "__pos"), "__key",
                          "item_id", order_col="__pos")
            .withColumn("item_id", F.col("item_id").cast("long")))


def load_review_tables(spark: SparkSession, catalog_csv: str, reviews_csv: str) -> ReviewTables:
    info = C.with_role_names(C.trim_columns(read_csv_safely(spark, catalog_csv)), _roles(CATALOG_SYNONYMS))
    com = C.with_role_names(C.trim_columns(read_csv_safely(spark, reviews_csv)), _roles(REVIEW_SYNONYMS))
    C.require_columns(info, ["Hotel_ID", "Hotel_Name"], os.path.basename(catalog_csv))
    C.require_columns(com, ["Reviewer_Name", "Hotel_ID"], os.path.basename(reviews_csv))
    info = C.with_joined_default(info, "Hotel_Description", ("Hotel_Name", "Hotel_Address")).withColumn("__pos", F.monotonically_increasing_id())
    com = com.withColumn("__pos", F.monotonically_increasing_id())
    # freeze file order and the (possibly non-deterministic) decoding once
    info, com = cut_lineage(info), cut_lineage(com)

    key_type = dict(info.dtypes)["Hotel_ID"]
    com = C.align_key_type(com, "Hotel_ID", info, "Hotel_ID")
    idmap = _item_ids(info, "Hotel_ID")
    key = F.col("Hotel_ID") if key_type in ("int", "bigint", "smallint", "tinyint") \
        else F.col("Hotel_ID").cast("string")
    catalog = (info.withColumn("__key", key).join(idmap, "__key")
               .select("item_id", F.col("Hotel_ID").alias("item_key"),
                       F.col("Hotel_Name").cast("string").alias("name"),
                       F.col("Hotel_Name").cast("string").alias("display_name"),
                       T.as_text(F.col("Hotel_Description")).alias("text")))
    strings = [f.name for f in com.schema.fields if isinstance(f.dataType, StringType)]
    merged = F.concat_ws(" ", *[T.as_text(F.col(f"`{c}`")) for c in strings]) if strings else F.lit("")
    # anonymous reviews stay in the text corpus; only pairs and ratings need a user
    com = com.withColumn("__key", key).join(idmap, "__key")
    reviews = com.select("item_id", F.col("__pos").alias("seg_order"), merged.alias("merged"))
    score = F.col("Score") if "Score" in com.columns else F.lit(None).cast("string")
    interactions = com.dropna(subset=["Reviewer_Name"]).select(F.col("Reviewer_Name").cast("string").alias("user_id"), "item_id",
                              score.cast("string").alias("raw_score"), F.col("__pos").alias("pos"))
    return ReviewTables(catalog, reviews, interactions)


def load_lexicons(spark: SparkSession, dict_dir: str | None) -> Lexicons:
    """S2 for the five dictionaries; absent files give empty dictionaries."""
    if not dict_dir:
        return Lexicons()
    got = {}
    for name, (fname, sep) in DICTIONARY_FILES.items():
        d = read_dict(spark, os.path.join(dict_dir, fname), sep=sep)
        got[name] = collect_map(d) if sep else collect_set(d)
        if got[name] is None:
            raise ValueError(f"{fname} is larger than the inline dictionary bound; "
                             "use lexicon.map_tokens_join / drop_tokens_join")
    return Lexicons(emoji=got["emoji"], teencode=got["teencode"], wrong=got["wrong"],
                    en_vi=got["en_vi"], stopwords=got["stopwords"])


def ratings(tables: ReviewTables) -> DataFrame:
    """T12 + P12 + P13: (userId, itemId, rating) with reviewer names densely coded."""
    parsed = tables.interactions.withColumn("rating", normalize_rating(F.col("raw_score")))
    users = ids.dense_ids(parsed, "user_id", "userId", order_col="pos")
    return factor.ratings_frame(parsed.join(users, "user_id"), "userId", "item_id", "rating")


def run(spark: SparkSession, catalog_csv: str, reviews_csv: str, out_dir: str,
        dict_dir: str | None = None, embeddings: DataFrame | None = None,
        methods=("tfidf", "embedding", "word2vec"), grid: dict | None = None,
        stamp: str | None = None) -> dict[str, str]:
    """Load, evaluate the content methods, search ALS, write the tables."""
    stamp = stamp or run_stamp()
    t = load_review_tables(spark, catalog_csv, reviews_csv)
    lex = load_lexicons(spark, dict_dir)
    rows = cut_lineage(E.eval_rows_frames(t.catalog, t.reviews, t.interactions, lex, embeddings, methods))
    out = out_dir.rstrip("/")
    paths = {"eval_rows": f"{out}/logs/eval_rows_{stamp}",
             "eval_summary": f"{out}/logs/eval_summary_{stamp}",
             "als_trials": f"{out}/logs/als_trials_{stamp}",
             "best_model": f"{out}/models/best_als"}
    write_table(ranking.round_metrics(rows), paths["eval_rows"], fmt="csv", single_file=True)
    write_table(ranking.summarize(rows), paths["eval_summary"], fmt="csv", single_file=True)
    result = factor.grid_search(ratings(t), grid)
    write_table(result.trials, paths["als_trials"], fmt="csv", single_file=True)
    factor.save_model(result.best_model, paths["best_model"])
    return paths
