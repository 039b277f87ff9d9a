"""End-to-end run that writes the result tables (S6, S7, T18, M10 -> S4):
per-seed evaluation rows, the (method, K) summary, the ALS trials, the best
ALS model and the per-user recommendation table, under one run stamp.  The
only actions are the writes.  The evaluation and trial tables are bounded
(seeds x K x methods, 18 trials) and written as single CSV files; the
recommendation table grows with the users and keeps its partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.operators import factor, ranking
from recolens.plans import driver
from recolens.plans import evaluation as E
from recolens.plans import ratingplans as RP
from recolens.session import cut_lineage
from recolens.sources.files import run_stamp, write_table


def recommendation_table(spark: SparkSession, sf_dir: str, model, n: int = factor.TOP_N) -> DataFrame:
    """M10 -> S4: ``(UserName, RecommendedHotel, rank)`` from the factor model's
    top-n per user, users and items by display name (the table the
    per-user page reads)."""
    recs = factor.recommend_blocked(model, n)
    users = driver.customers(spark, sf_dir).select(F.col("user_id").cast("int").alias("userId"),
                                                    F.col("user_name").alias("UserName"))
    items = driver.catalog(spark, sf_dir).select(F.col("item_id").cast("int").alias("itemId"),
                                                  F.col("display_name").alias("RecommendedHotel"))
    return recs.join(users, "userId").join(items, "itemId").select("UserName", "RecommendedHotel", "rank")


def write_reports(spark: SparkSession, sf_dir: str, out_dir: str, methods=E.ALL_METHODS,
                  grid: dict | None = None, stamp: str | None = None) -> dict[str, str]:
    stamp = stamp or run_stamp()
    out = out_dir.rstrip("/")
    paths = {
        "eval_rows": f"{out}/logs/eval_rows_{stamp}",
        "eval_summary": f"{out}/logs/eval_summary_{stamp}",
        "als_trials": f"{out}/logs/als_trials_{stamp}",
        "best_model": f"{out}/models/best_als",
        "recommendations": f"{out}/recommendations_{stamp}",
    }
    rows = cut_lineage(E.eval_rows(spark, sf_dir, methods))
    write_table(ranking.round_metrics(rows), paths["eval_rows"], fmt="csv", single_file=True)
    write_table(ranking.summarize(rows), paths["eval_summary"], fmt="csv", single_file=True)
    result = factor.grid_search(RP._ratings(spark, sf_dir), grid)
    write_table(result.trials, paths["als_trials"], fmt="csv", single_file=True)
    factor.save_model(result.best_model, paths["best_model"])
    # grows with the users: keep the partitioning
    write_table(recommendation_table(spark, sf_dir, result.best_model), paths["recommendations"], fmt="csv")
    return paths
