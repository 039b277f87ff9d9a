"""Serving entry points of the app, as DataFrame functions (section 3.3):

* ``search(text, k)``     - free-text query -> top-k catalog items (M3, J7, K4)
* ``similar(name, k)``    - first item with that name -> top-k by TF-IDF or
                            embeddings, self excluded by id (P16, K3, J8)
* ``recommend(user)``     - rows of the precomputed recommendation table for
                            one user, joined to the catalog by name (P17, J2)

A ``ContentIndex`` holds the fitted vocabulary and the item weights; callers
that serve many requests persist it once (``save``) and reload it, instead of
refitting per request as the app does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators import similarity, tfidf
from recolens.session import cut_lineage


@dataclass
class ContentIndex:
    model: tfidf.TfidfModel
    weights: DataFrame        # (item_id, term, w) un-normalised
    catalog: DataFrame        # (item_id, name, ...)

    def save(self, path: str) -> None:
        self.model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark: SparkSession, path: str, catalog: DataFrame, n_docs: int,
             max_features: int | None = 10_000) -> "ContentIndex":
        vocab = spark.read.parquet(f"{path}/vocab")
        return ContentIndex(tfidf.TfidfModel(vocab, n_docs, max_features),
                            spark.read.parquet(f"{path}/weights"), catalog)


def build_index(catalog: DataFrame, text_col: str = "text", max_features: int = 10_000,
                min_df: int = 2) -> ContentIndex:
    """M2: app-style TF-IDF over the catalog descriptions (T10 cleaning)."""
    n = catalog.count()
    seg = tfidf.single_segment(
        catalog.select("item_id", T.preprocess_text(F.col(text_col)).alias("text")), "item_id", "text")
    _, model, w = tfidf.fit_corpus(seg, n, min_df=min_df, max_features=max_features,
                                   multi_segment=False)
    return ContentIndex(model, cut_lineage(w), catalog)


def search(index: ContentIndex, query: str, k: int = 9) -> DataFrame:
    """K4: top-k items for one free-text query (the query is one tiny row)."""
    spark = index.catalog.sparkSession
    q = spark.createDataFrame([(0, 0, query)], "item_id long, seg_order long, text string")
    q = q.select("item_id", "seg_order", T.preprocess_text(F.col("text")).alias("text"))
    qw = (tfidf.raw_weights(tfidf.segment_terms(q, materialize=False, multi_segment=False), index.model)
          .withColumnRenamed("item_id", "seed_id"))
    top = similarity.cosine_topk_for_queries(qw, index.weights, k)
    return top.join(index.catalog, "item_id").orderBy("rank")


def seed_by_id(catalog: DataFrame, item_id) -> DataFrame:
    """J14 + P16: the seed row for an id; raises when the id is not in the
    catalog (one bounded existence probe)."""
    seed = catalog.where(F.col("item_id") == F.lit(item_id)).select(F.col("item_id").alias("seed_id"))
    if seed.limit(1).count() == 0:
        raise ValueError(f"item id {item_id!r} not found in the catalog")
    return seed.distinct()


def seed_by_name(catalog: DataFrame, name: str) -> DataFrame:
    """The first item (lowest id) with that name; empty when unknown."""
    return (catalog.where(F.col("name") == F.lit(name))
            .agg(F.min("item_id").alias("seed_id")).where(F.col("seed_id").isNotNull()))


def similar(index: ContentIndex, name: str, k: int = 9, embeddings: DataFrame | None = None) -> DataFrame:
    """K3: similar items to the named item; with ``embeddings`` given, by
    embedding cosine (J8), else by TF-IDF cosine."""
    seed = seed_by_name(index.catalog, name)
    if embeddings is not None:
        top = similarity.embedding_topk_for_seeds(embeddings, seed, k)
    else:
        top = similarity.cosine_topk_for_seeds(index.weights, seed, k)
    return top.join(index.catalog, "item_id").orderBy("rank")


def recommend(recs: DataFrame, catalog: DataFrame, user: str) -> DataFrame:
    """P17 + J2: one user's precomputed rows, inner-joined by name."""
    mine = recs.where(F.col("UserName") == F.lit(user))
    return mine.join(catalog, mine.RecommendedHotel == catalog.name)


def user_list(recs: DataFrame) -> DataFrame:
    """A11 for the recommendation page."""
    return recs.select("UserName").distinct().orderBy("UserName")
