"""Ratings, ids, ALS and recommendation-table plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recolens.functions import columns as COL
from recolens.functions import rating as R
from recolens.functions import text as T
from recolens.operators import factor, ids, wordvec
from recolens.operators.ranking import top_k
from recolens.plans import driver
from recolens.operators.lexicon import Lexicons, preprocess
from recolens.plans import evaluation as E
from recolens.session import written

USER_RECS_TOP = 3   # items per user in the precomputed recommendation table


# ------------------------------------------------------------------ Spark

def rating_parse(spark, sf):
    i = driver.interactions(spark, sf)
    return i.select("l_orderkey", "l_linenumber", "raw_score",
                    R.normalize_rating(F.col("raw_score")).alias("rating_clean"))


def rating_unparsed(spark, sf):
    """Distinct raw values that could not be parsed, first 10 in order of
    first appearance (order key, line number)."""
    p = rating_parse(spark, sf).where(R.unparsed(F.col("raw_score"), F.col("rating_clean")))
    first = p.groupBy("raw_score").agg(
        F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return (first.select("raw_score", F.col("f.l_orderkey").alias("first_orderkey"),
                         F.col("f.l_linenumber").alias("first_linenumber"))
            .orderBy("first_orderkey", "first_linenumber").limit(10))


def _named_interactions(spark, sf):
    return driver.interactions(spark, sf).join(driver.customers(spark, sf), "user_id")


def id_encode(spark, sf):
    """Users identified by display name get dense 0-based ids (name order)."""
    return ids.dense_ids(_named_interactions(spark, sf), "user_name", "user_idx")


def distinct_users(spark, sf):
    """Sorted distinct user names."""
    return _named_interactions(spark, sf).select("user_name").distinct().orderBy("user_name")


def distinct_item_names(spark, sf):
    """A10: distinct catalog names in first-appearance (id) order."""
    cat = driver.catalog(spark, sf)
    return (cat.groupBy("name").agg(F.min("item_id").alias("first_item_id"))
            .orderBy("first_item_id"))


def missing_labels(spark, sf):
    """P19 on the raw score strings (as the app labels rank / score fields)."""
    i = driver.interactions(spark, sf)
    return i.select("l_orderkey", "l_linenumber", COL.missing_label(F.col("raw_score")).alias("display"))


def user_recs_table(spark, sf):
    """S4 input shape ``(UserName, RecommendedHotel)``: each user's top items by
    total rating, as names (a deterministic stand-in for the precomputed file)."""
    i = _named_interactions(spark, sf)
    per = i.groupBy("user_name", "item_id").agg(F.sum("rating").alias("score"))
    top = top_k(per, ["user_name"], "score", "item_id", USER_RECS_TOP, digits=6)
    cat = driver.catalog(spark, sf).select("item_id", "display_name")
    return top.join(cat, "item_id").select(F.col("user_name").alias("UserName"),
                                            F.col("display_name").alias("RecommendedHotel"))


def user_recs_join(spark, sf):
    """Recommendation rows joined to the catalog by *name* (inner join, as
    the app's merge; a repeated name would fan out - see the serve tests)."""
    recs = user_recs_table(spark, sf)
    cat = driver.catalog(spark, sf).select("item_id", "display_name")
    return (recs.join(cat, recs.RecommendedHotel == cat.display_name)
            .select(F.col("UserName").alias("user_name"), F.col("RecommendedHotel").alias("recommended"),
                    "item_id"))


def _ratings(spark, sf):
    """One rating per interaction row, parsed from the dirty score."""
    i = driver.interactions(spark, sf).withColumn(
        "rating_clean", R.normalize_rating(F.col("raw_score")))
    return factor.ratings_frame(i, "user_id", "item_id", "rating_clean")


_GRIDS: dict[tuple, factor.GridResult] = {}


def grid(spark: SparkSession, sf: str) -> factor.GridResult:
    """The grid of a session and folder, fitted once for the queries that report on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRIDS:
        _GRIDS[key] = factor.grid_search(_ratings(spark, sf))
    return _GRIDS[key]


def als_split(spark, sf):
    """The hold-out of every rating."""
    train, test = factor.split(_ratings(spark, sf))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


BASELINE_REGS = (0.0, 1.0, 5.0, 25.0)


def _baseline_trials(spark, sf):
    train, test = factor.split(_ratings(spark, sf))
    by_reg = factor.rmse_by(factor.item_mean_predictions(train, test, BASELINE_REGS), "regParam")
    number = F.array_position(F.array(*(F.lit(r) for r in BASELINE_REGS)), F.col("regParam"))
    return by_reg.select(number.cast("int").alias("trial"), F.lit(0).alias("rank"), "regParam", F.lit(0).alias("maxIter"),
                         F.round("rmse", 6).alias("rmse"), "n")


def baseline_trials(spark, sf):
    """The error of shrunken item means on the hold-out, for each shrinkage."""
    return _baseline_trials(spark, sf)


def baseline_best(spark, sf):
    """The best of them."""
    return factor.best_trial(_baseline_trials(spark, sf))


def als_grid(spark, sf):
    return grid(spark, sf).trials


def best_trial(spark, sf):
    return factor.best_trial(grid(spark, sf).trials)


def als_recommend(spark, sf):
    """Top 10 per user from the best model, flattened, with names."""
    model = grid(spark, sf).best_model
    return factor.with_names(factor.recommend_blocked(model), driver.catalog(spark, sf))


def doc_embedding(spark, sf):
    """M4 (re-aimed): Word2Vec (128-d, window 5, min count 2, seed 42) over the
    cleaned documents; a document vector is the mean of its word vectors."""
    stop = E.doc_stopwords(spark, sf)
    d = driver.documents(spark, sf).select(
        "item_id", T.split_tokens(preprocess(F.col("text"), Lexicons(stopwords=stop))).alias("toks"))
    d = written(d, "tokens")
    return wordvec.row_means(wordvec.fit(d), d).withColumnRenamed("item_id", "doc_id")


# -------------------------------------------------------------------- SQL

_S = "regexp_replace(raw_score, '^[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{Z}]+$', '', 'g')"
_NUM = r"([0-9]{1,3}(?:[.,][0-9]{1,2})?)"
_X = f"TRY_CAST(replace(NULLIF(regexp_extract(s, '{_NUM}', 1), ''), ',', '.') AS DOUBLE)"
RATING_EXPR_SQL = f"""CASE WHEN s IN ('', 'nan', 'None', 'N/A', 'na') OR s IS NULL OR {_X} IS NULL THEN NULL
  ELSE greatest(least({_X}, 10.0), 0.0) END"""

RATING_CTE = f"""WITH inter_rows AS ({driver.INTERACTIONS_SQL}),
parsed AS (SELECT l_orderkey, l_linenumber, raw_score, user_id, item_id,
                  {RATING_EXPR_SQL} AS rating_clean
           FROM (SELECT *, {_S} AS s FROM inter_rows))"""
RATING_PARSE_SQL = RATING_CTE + "\nSELECT l_orderkey, l_linenumber, raw_score, rating_clean FROM parsed"
SPLIT_CTE = RATING_CTE + f""",
ratings AS (SELECT CAST(user_id AS INTEGER) AS "userId", CAST(item_id AS INTEGER) AS "itemId", rating_clean AS rating
            FROM parsed WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND rating_clean IS NOT NULL),
placed AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(concat_ws('|', "userId", "itemId",
             CAST(round(rating * 100) AS BIGINT), {factor.SEED})), 1, 7) AS BIGINT) % 1000 < 800
           THEN 'train' ELSE 'test' END AS part FROM ratings)"""
ALS_SPLIT_SQL = SPLIT_CTE + '\nSELECT "userId", "itemId", rating, part FROM placed'
BASELINE_CTE = SPLIT_CTE + f""",
items AS (SELECT "itemId", sum(rating) AS s, count(*) AS n FROM placed WHERE part = 'train' GROUP BY "itemId"),
mean AS (SELECT avg(rating) AS mu FROM placed WHERE part = 'train'),
regs AS (SELECT unnest({list(BASELINE_REGS)})::DOUBLE AS reg),
trials AS (SELECT list_position({list(BASELINE_REGS)}::DOUBLE[], reg) AS trial, 0 AS rank, reg AS "regParam", 0 AS "maxIter",
                  round(sqrt(avg((p.rating - (i.s + reg * mu) / (i.n + reg)) ** 2)), 6) AS rmse, count(*) AS n
           FROM placed p JOIN items i ON i."itemId" = p."itemId", mean, regs WHERE p.part = 'test' GROUP BY reg)"""
BASELINE_TRIALS_SQL = BASELINE_CTE + '\nSELECT CAST(trial AS INTEGER) AS trial, rank, "regParam", "maxIter", rmse, n FROM trials'
BASELINE_BEST_SQL = (BASELINE_CTE + '\nSELECT CAST(trial AS INTEGER) AS trial, rank, "regParam", "maxIter", rmse FROM trials '
                     "ORDER BY rmse, trial LIMIT 1")
RATING_UNPARSED_SQL = RATING_CTE + """
SELECT raw_score, first_orderkey, first_linenumber FROM (
  SELECT raw_score, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_orderkey,
         arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS first_linenumber
  FROM parsed WHERE rating_clean IS NULL AND raw_score IS NOT NULL GROUP BY raw_score)
ORDER BY first_orderkey, first_linenumber LIMIT 10"""

NAMED_CTE = f"""WITH inter_rows AS ({driver.INTERACTIONS_SQL}),
named AS (SELECT i.*, c.c_name AS user_name FROM inter_rows i JOIN customer c ON c.c_custkey = i.user_id)"""
ID_ENCODE_SQL = NAMED_CTE + """
SELECT user_name, CAST(dense_rank() OVER (ORDER BY user_name) - 1 AS INTEGER) AS user_idx
FROM (SELECT DISTINCT user_name FROM named WHERE user_name IS NOT NULL)"""
DISTINCT_USERS_SQL = NAMED_CTE + "\nSELECT DISTINCT user_name FROM named ORDER BY user_name"
DISTINCT_ITEM_NAMES_SQL = ("SELECT p_name AS name, min(p_partkey) AS first_item_id FROM part "
                           "GROUP BY p_name ORDER BY first_item_id")
MISSING_LABELS_SQL = f"""WITH inter_rows AS ({driver.INTERACTIONS_SQL})
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_matches(lower(v), '{COL.MISSING_PATTERN}') THEN '{COL.MISSING_LABEL}' ELSE v END AS display
FROM (SELECT l_orderkey, l_linenumber, trim(coalesce(raw_score, '{COL.DEFAULT_VALUE}')) AS v FROM inter_rows)"""
USER_RECS_JOIN_SQL = NAMED_CTE + f""",
per AS (SELECT user_name, item_id, sum(rating) AS score FROM named GROUP BY user_name, item_id),
top AS (SELECT user_name, item_id FROM per
        QUALIFY row_number() OVER (PARTITION BY user_name ORDER BY round(score, 6) DESC, item_id) <= {USER_RECS_TOP}),
cat AS (SELECT p_partkey, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS display_name FROM part),
recs AS (SELECT t.user_name AS UserName, c.display_name AS RecommendedHotel FROM top t JOIN cat c ON c.p_partkey = t.item_id)
SELECT r.UserName AS user_name, r.RecommendedHotel AS recommended, c.p_partkey AS item_id
FROM recs r JOIN cat c ON c.display_name = r.RecommendedHotel"""
