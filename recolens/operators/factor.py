"""ALS factor models: ingest, hold-out grid search, predictions, top-k per user
(S5, P12, P14, P18, A5, A9, M7-M10, K6, P23, J3).

MLlib's ALS is the distributed solver (block-partitioned factors, NNLS when
``nonnegative``).  The grid loops over *parameters* on the driver - each fit
is a distributed job; the split is frozen by a reliable checkpoint so all 18
trials see the same rows, and ALS itself checkpoints its factor lineage into
the session checkpoint folder every ``checkpointInterval`` iterations.
"""

from __future__ import annotations

import gc
import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from recolens.session import checkpoint_dir, written

# Fixed values of the reference's search (must match it).
PARAM_GRID = {"rank": [10, 20, 40], "regParam": [0.01, 0.05, 0.1], "maxIter": [10, 15]}
SPLIT = (0.8, 0.2)
SEED = 42
TOP_N = 10
#: Iterations whose factors MLlib keeps as shuffle files at most; a checkpoint lets them go.
CHECKPOINT_INTERVAL = 2

TRIAL_SCHEMA = StructType([
    StructField("trial", IntegerType()), StructField("rank", IntegerType()),
    StructField("regParam", DoubleType()), StructField("maxIter", IntegerType()),
    StructField("rmse", DoubleType())])


def ratings_frame(df: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """S5 + P12 + P14: ``(userId INT, itemId INT, rating DOUBLE)``, nulls dropped."""
    return df.select(F.col(user).cast("int").alias("userId"),
                     F.col(item).cast("int").alias("itemId"),
                     F.col(rating).cast("double").alias("rating")).dropna()


def coded_ratings(df: DataFrame, user: str, item: str, rating: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings with dense ids for keys of any type and size, which MLlib's 32-bit ids could
    not hold, and the tables (key, id) of users and items to read results back by."""
    from recolens.operators.ids import dense_ids
    rows = df.select(F.col(user).alias("user_key"), F.col(item).alias("item_key"),
                     F.col(rating).cast("double").alias("rating")).dropna()
    users, items = dense_ids(rows, "user_key", "userId"), dense_ids(rows, "item_key", "itemId")
    coded = rows.join(users, "user_key").join(items, "item_key").select("userId", "itemId", "rating")
    return coded, users, items


def decoded(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Recommendations under the keys that ``coded_ratings`` replaced."""
    return recs.join(users, "userId").join(items, "itemId").drop("userId", "itemId")


def make_als(rank: int, reg: float, iters: int, seed: int = SEED) -> ALS:
    """M7 with the reference's settings (+ a seed, so fits are repeatable); as many
    blocks as the cluster has cores, ten at least."""
    active = SparkSession.getActiveSession()
    blocks = max(10, active.sparkContext.defaultParallelism if active else 10)
    return ALS(numUserBlocks=blocks, numItemBlocks=blocks, rank=rank, regParam=reg, maxIter=iters, userCol="userId", itemCol="itemId",
               ratingCol="rating", nonnegative=True, coldStartStrategy="drop", seed=seed,
               checkpointInterval=CHECKPOINT_INTERVAL)


def rmse(model: ALSModel, test: DataFrame) -> float:
    """M8 + P18 + A5: predictions kept where present, then RMSE."""
    return RegressionEvaluator(metricName="rmse", labelCol="rating",
                               predictionCol="prediction").evaluate(with_prediction(model.transform(test)))


def with_prediction(predictions: DataFrame) -> DataFrame:
    """Rows that the model could predict."""
    return predictions.where(F.col("prediction").isNotNull())


def rmse_by(predictions: DataFrame, *group: str) -> DataFrame:
    """A5 as a table: ``(group..., n, rmse)`` over the rows with a prediction."""
    error = F.col("rating") - F.col("prediction")
    return (with_prediction(predictions).groupBy(*group)
            .agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse")))


def item_mean_predictions(train: DataFrame, test: DataFrame, regs) -> DataFrame:
    """``test`` under each ``regParam``: an item's mean rating drawn to the overall mean as by
    ``regParam`` further ratings.  Items without a rating in ``train`` have none."""
    mean = train.agg(F.avg("rating")).first()[0]
    items = train.groupBy("itemId").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    reg = F.explode(F.array(*(F.lit(float(r)) for r in regs))).alias("regParam")
    return (test.join(items, "itemId", "left").select("userId", "itemId", "rating", "s", "n", reg)
            .withColumn("prediction", (F.col("s") + F.col("regParam") * F.lit(mean)) / (F.col("n") + F.col("regParam")))
            .drop("s", "n"))


def split_share(seed: int = SEED):
    """A rating's place in 0..999 by a digest of its row, which any SQL engine can repeat."""
    row = F.concat_ws("|", "userId", "itemId", F.round(F.col("rating") * 100).cast("long"), F.lit(seed))
    return F.conv(F.substring(F.md5(row), 1, 7), 16, 10).cast("long") % 1000


def split(ratings: DataFrame, seed: int = SEED):
    """80/20 hold-out by a hash of the row, so it does not depend on partitioning; the
    ratings are read and placed once, both parts are filters of one written table."""
    cut = SPLIT[0] / sum(SPLIT) * 1000
    placed = written(ratings.withColumn("__train", split_share(seed) < cut), "ratings")
    return placed.where("__train").drop("__train"), placed.where("not __train").drop("__train")


@dataclass
class GridResult:
    trials: DataFrame
    best_params: dict
    best_rmse: float
    best_model: ALSModel


def grid_search(ratings: DataFrame, grid: dict | None = None, parallelism: int | None = None,
                seed: int = SEED) -> GridResult:
    """M9: every (rank, regParam, maxIter) on one hold-out; keep the minimum
    RMSE (the first trial wins a tie).  Trials are numbered rank-major as in
    the reference.  ``parallelism`` trials are fitted concurrently (separate
    Spark jobs sharing the executors; each fit is seeded, so the result does
    not depend on it)."""
    spark = ratings.sparkSession
    checkpoint_dir(spark)
    if parallelism is None:
        parallelism = max(1, min(4, spark.sparkContext.defaultParallelism // 2))
    grid = grid or PARAM_GRID
    train, test = split(ratings, seed)
    combos = list(itertools.product(grid["rank"], grid["regParam"], grid["maxIter"]))

    def run(i_combo):
        i, (r, reg, it) = i_combo
        model = make_als(r, reg, it, seed).fit(train)
        error = rmse(model, test)
        shuffles_collected(spark)
        return i, (r, reg, it), error, model

    best = None
    rows = []
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for i, (r, reg, it), e, model in pool.map(run, enumerate(combos, start=1)):
            rows.append((i, int(r), float(reg), int(it), float(e)))
            if best is None or e < best[2] or (e == best[2] and i < best[0]):
                best = (i, (r, reg, it), e, model)
    trials = spark.createDataFrame(sorted(rows), TRIAL_SCHEMA)
    r, reg, it = best[1]
    return GridResult(trials, {"rank": r, "regParam": reg, "maxIter": it}, best[2], best[3])


def shuffles_collected(spark: SparkSession) -> None:
    """Let the files of ended fits go: MLlib leaves the shuffles that placed the ratings to the
    driver's garbage collection, which may not come before the last fit."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with minimum RMSE; ties -> lowest trial number."""
    return trials.agg(F.min_by(F.struct("trial", "rank", "regParam", "maxIter", "rmse"),
                               F.struct("rmse", "trial")).alias("b")).select("b.*")


def recommend_all(model: ALSModel, n: int = TOP_N) -> DataFrame:
    """K6 for every user + P23 flatten via MLlib's ``recommendForAllUsers``
    (which pairs user and item blocks in a cartesian product internally;
    ``recommend_blocked`` is the cartesian-free form used by the plans)."""
    recs = model.recommendForAllUsers(n)
    return recs.select("userId", F.posexplode("recommendations").alias("pos", "r")).select(
        "userId", F.col("r.itemId").alias("itemId"), F.col("r.rating").cast("double").alias("score"),
        (F.col("pos") + 1).alias("rank"))


def recommend_blocked(model: ALSModel, n: int = TOP_N, users: DataFrame | None = None,
                      block_rows: int = 4096) -> DataFrame:
    """K6/M10 without a cartesian product: ``(userId, itemId, score, rank)``.

    Users and items are hashed into blocks of about ``block_rows`` factors;
    every (user block, item block) pair is one cogroup group scored by one
    matrix product, and only each user's best ``n`` of that item block leave
    the task (ties kept).  A final ``row_number() <= n`` per user merges the
    blocks.  Work is users x items (the operator's definition); memory per
    task is two factor blocks and one score block; no pair is emitted as a
    row.  Ties are broken by item id."""
    from recolens.operators.similarity import dense_topk_blocked
    uf = model.userFactors
    if users is not None:
        uf = uf.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    top = dense_topk_blocked(
        uf.select(F.col("id").cast("long").alias("seed_id"), F.col("features").alias("embedding")),
        model.itemFactors.select(F.col("id").cast("long").alias("item_id"),
                                 F.col("features").alias("embedding")),
        n, cosine=False, block_rows=block_rows)
    return top.select(F.col("seed_id").cast("int").alias("userId"),
                      F.col("item_id").cast("int").alias("itemId"),
                      F.col("similarity").alias("score"), "rank")


def recommend_bounded(model: ALSModel, n: int = TOP_N, users: DataFrame | None = None,
                      block_items: int | None = None) -> DataFrame:
    """K6/M10, exact, without scoring every pair: ``(userId, itemId, score, rank)``.

    Items lie in blocks by norm; a user reads a block only where the product of both
    norms and the angle between them can reach the user's n-th score so far
    (``dense_index``).  Scores are rounded to 6 digits, equal ones by item id."""
    from recolens.operators import blocks, dense_index
    uf = model.userFactors
    if users is not None:
        uf = uf.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    items = model.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("embedding"))
    index = dense_index.build(items, cosine=False, block_items=block_items or blocks.BLOCK_ITEMS)
    top = dense_index.topk(uf.select(F.col("id").alias("seed_id"), F.col("features").alias("embedding")), index, n).top
    return top.select(F.col("seed_id").cast("int").alias("userId"), F.col("item_id").cast("int").alias("itemId"),
                      F.col("similarity").alias("score"), "rank")


def recommend_users(model: ALSModel, users: DataFrame, n: int = TOP_N) -> DataFrame:
    """K6 for a user subset (``users`` has a ``userId`` column)."""
    recs = model.recommendForUserSubset(users.select("userId"), n)
    return recs.select("userId", F.posexplode("recommendations").alias("pos", "r")).select(
        "userId", F.col("r.itemId").alias("itemId"), F.col("r.rating").cast("double").alias("score"),
        (F.col("pos") + 1).alias("rank"))


def with_names(recs: DataFrame, catalog: DataFrame, id_col: str = "item_id",
               name_col: str = "name") -> DataFrame:
    """Attach catalog names (left join, ids aligned by cast)."""
    cat = catalog.select(F.col(id_col).cast("int").alias("itemId"), F.col(name_col).alias("name"))
    return recs.join(cat, "itemId", "left")


def save_model(model: ALSModel, path: str) -> None:
    """Overwrite-save."""
    model.write().overwrite().save(path)


def load_model(path: str) -> ALSModel:
    return ALSModel.load(path)
