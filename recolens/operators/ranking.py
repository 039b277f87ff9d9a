"""Ranking evaluation at K: precision, average precision, binary and graded nDCG.

One plan for all methods, seeds and K values: recommendations are left-joined
to the relevance list on ``(seed_id, item_id)``; a running hit count (window
over one seed's list, bounded by the list length) feeds average precision;
``explode(array(K...))`` fans each row out to the K values it counts for; one
``groupBy(method, seed, K)`` produces every sum.  No per-seed driver loop.

Metric definitions follow the reference exactly:

* precision@K = hits in the first K / K (even when fewer than K were returned);
* AP@K = sum(hits_so_far / rank at each hit) / max(min(n_rel, K), 1);
* binary nDCG@K: DCG of the first K over an ideal DCG that spans the *whole*
  relevant list (``ideal='full'``), or only its first K (``ideal='at_k'``);
* graded nDCG@K: gain ``2^jaccard - 1``; ideal = best K gains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K_LIST = (5, 10, 20)   # fixed value of the evaluation protocol
REC_TOPN = 200         # recommendations per seed that are evaluated


def _k_column(ks) -> F.Column:
    return F.explode(F.array(*[F.lit(int(k)) for k in ks]))


def _log2(c):
    return F.log2(c.cast("double"))


def _ideal_binary(n_rel: F.Column, k: F.Column, ideal: str) -> F.Column:
    """Sum of 1/log2(i+1) for i = 1..n (n = n_rel, or min(n_rel, K))."""
    n = n_rel if ideal == "full" else F.least(n_rel, k)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0),
                                     lambda acc, i: acc + 1.0 / F.log2(i + 1))).otherwise(F.lit(0.0))


def evaluate(recs: DataFrame, relevance: DataFrame, eval_seeds: DataFrame,
             ks=K_LIST, ideal: str = "full") -> DataFrame:
    """Per-seed metrics.

    recs:       (method, seed_id, item_id, rank)   rank is 1-based
    relevance:  (seed_id, item_id, jaccard, rel_rank)
    eval_seeds: (method, seed_id)   seeds the method can answer (J13); seeds
                without any recommendation score 0.
    Output: (method, K, seed_id, precision, map, ndcg_bin, ndcg_grd, n_rel)
    """
    if ideal not in ("full", "at_k"):
        raise ValueError("ideal must be 'full' or 'at_k'")
    rel = relevance.select("seed_id", "item_id", "jaccard")
    n_rel = relevance.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_rel"))

    hits = (recs.join(rel, ["seed_id", "item_id"], "left")
            .withColumn("hit", F.col("jaccard").isNotNull().cast("int"))
            .withColumn("gain", F.coalesce(F.col("jaccard"), F.lit(0.0))))
    run = (Window.partitionBy("method", "seed_id").orderBy("rank")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = hits.withColumn("cum_hits", F.sum("hit").over(run))
    disc = _log2(F.col("rank") + 1)
    got = (hits.withColumn("K", _k_column(ks)).where(F.col("rank") <= F.col("K"))
           .groupBy("method", "seed_id", "K")
           .agg(F.sum("hit").alias("hits"),
                F.sum(F.col("hit") * F.col("cum_hits") / F.col("rank")).alias("ap_num"),
                F.sum(F.col("hit") / disc).alias("dcg_bin"),
                F.sum((F.pow(F.lit(2.0), F.col("gain")) - 1.0) / disc).alias("dcg_grd")))

    ideal_grd = (relevance.withColumn("K", _k_column(ks))
                 .where(F.col("rel_rank") <= F.col("K"))
                 .groupBy("seed_id", "K")
                 .agg(F.sum((F.pow(F.lit(2.0), F.col("jaccard")) - 1.0)
                            / _log2(F.col("rel_rank") + 1)).alias("idcg_grd")))

    base = (eval_seeds.select("method", "seed_id").distinct()
            .withColumn("K", _k_column(ks))
            .join(n_rel, "seed_id", "left")
            .withColumn("n_rel", F.coalesce(F.col("n_rel"), F.lit(0)))
            .join(got, ["method", "seed_id", "K"], "left")
            .join(ideal_grd, ["seed_id", "K"], "left"))
    k = F.col("K")
    idcg_bin = _ideal_binary(F.col("n_rel"), k, ideal)
    idcg_grd = F.coalesce(F.col("idcg_grd"), F.lit(0.0))
    return base.select(
        "method", "K", "seed_id",
        (F.coalesce(F.col("hits"), F.lit(0)) / k).alias("precision"),
        (F.coalesce(F.col("ap_num"), F.lit(0.0))
         / F.greatest(F.least(F.col("n_rel"), k), F.lit(1))).alias("map"),
        F.when(idcg_bin > 0, F.coalesce(F.col("dcg_bin"), F.lit(0.0)) / idcg_bin)
         .otherwise(F.lit(0.0)).alias("ndcg_bin"),
        F.when(idcg_grd > 0, F.coalesce(F.col("dcg_grd"), F.lit(0.0)) / idcg_grd)
         .otherwise(F.lit(0.0)).alias("ndcg_grd"),
        F.col("n_rel").cast("long").alias("n_rel"))


METRICS = ("precision", "map", "ndcg_bin", "ndcg_grd")


def summarize(rows: DataFrame) -> DataFrame:
    """Mean of the four metrics by (method, K), ordered by K, method."""
    return (rows.groupBy("method", "K")
            .agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS],
                 F.count(F.lit(1)).alias("n_seeds"))
            .withColumn("label", F.concat_ws("_", F.col("method"), F.col("K").cast("string")))
            .orderBy("K", "method"))


def round_metrics(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if c in METRICS else F.col(c)
                         for c in rows.columns])


def union_methods(frames: list[DataFrame]) -> DataFrame | None:
    """Concatenate the evaluation frames of the methods that exist."""
    present = [f for f in frames if f is not None]
    if not present:
        return None
    out = present[0]
    for f in present[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rank_within(df: DataFrame, group_cols, score_col: str, id_col: str,
                out_col: str = "rank", digits: int | None = 6) -> DataFrame:
    """1-based rank inside each group by score DESC, id ASC (ties by id on
    the score rounded to ``digits``, so engines with different float summation
    order agree)."""
    score = F.round(F.col(score_col), digits) if digits is not None else F.col(score_col)
    w = Window.partitionBy(*group_cols).orderBy(score.desc(), F.col(id_col).asc())
    return df.withColumn(out_col, F.row_number().over(w).cast("long"))


def top_k(df: DataFrame, group_cols, score_col: str, id_col: str, k: int,
          out_col: str = "rank", digits: int | None = 6) -> DataFrame:
    """K1/K2/K5: first ``k`` rows per group; the ``row_number <= k`` shape lets
    Spark insert a partial WindowGroupLimit before the shuffle."""
    return rank_within(df, group_cols, score_col, id_col, out_col, digits).where(F.col(out_col) <= k)
