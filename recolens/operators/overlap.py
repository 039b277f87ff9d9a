"""Co-reviewer overlap: Jaccard relevance between items that share users.

The relevance of item ``b`` to seed ``a`` is ``|U(a) & U(b)| / |U(a) | U(b)|``
over the sets of users who interacted with each item.  Nothing here emits all
item pairs of a user: the overlap is computed for a *seed set* (the evaluation
sample), by joining the seeds' users against the full pair table, and seed
eligibility is derived from per-user degree statistics without any pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolens.operators.joins import DEFAULT_BROADCAST_ROWS, checked_small, salted_join

# Fixed values of the evaluation protocol (must equal the reference's):
N_SEEDS = 300          # seeds sampled for evaluation
MIN_REL = 2            # a seed needs at least this many relevant items
RELEVANT_TOPN = 1000   # relevance list length per seed
SEED_RNG = 42          # sampling seed


def distinct_pairs(interactions: DataFrame, user_col: str = "user_id",
                   item_col: str = "item_id") -> DataFrame:
    """Distinct (user, item) pairs, rows with a null key dropped.

    ``distinct`` plans a partial (map-side) aggregate first, so duplicate rows
    of a hot user are collapsed before the shuffle."""
    return (interactions.select(F.col(user_col).alias("user_id"), F.col(item_col).alias("item_id"))
            .dropna().distinct())


def item_user_counts(pairs: DataFrame) -> DataFrame:
    """Number of distinct users per item (partial aggregation, skew-safe)."""
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_users"))


def eligible_items(pairs: DataFrame, min_rel: int = MIN_REL) -> DataFrame:
    """Items that share a user with at least ``min_rel`` other items.

    Pair-free.  Of each user only the ``min_rel + 1`` smallest items are kept: they hold
    ``min_rel`` others of any item if the user has as many, and all of them if not.  An
    item qualifies by one user of more than ``min_rel`` items, or by ``min_rel``
    distinct partners from users that all have fewer."""
    if min_rel < 1:
        return pairs.select("item_id").distinct()
    mine = Window.partitionBy("user_id").orderBy("item_id")
    smallest = (pairs.withColumn("place", F.row_number().over(mine)).where(F.col("place") <= min_rel + 1)
                .groupBy("user_id").agg(F.collect_list("item_id").alias("some")))
    met = pairs.join(smallest, "user_id")
    full = met.where(F.size("some") > min_rel).select("item_id").distinct()
    few = (met.where((F.size("some") <= min_rel) & (F.size("some") > 1))
           .select("item_id", F.explode("some").alias("other")).where("item_id <> other").distinct()
           .groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_rel).select("item_id"))
    return full.unionByName(few).distinct()


def sample_order(id_col: str, seed: int = SEED_RNG):
    """Deterministic pseudo-random order key (LCG step on the id).

    Integer arithmetic only, so any SQL engine reproduces the same sample; the
    id is reduced before the product, so no id overflows 64 bits."""
    return F.pmod(F.pmod(F.col(id_col), F.lit(2147483648)) * F.lit(1103515245) + F.lit(12345 + seed), F.lit(2147483648))


def sample_seeds(candidates: DataFrame, n: int = N_SEEDS, seed: int = SEED_RNG,
                 id_col: str = "item_id") -> DataFrame:
    """K9: ``min(n, |candidates|)`` seeds without replacement.

    ``orderBy(...).limit(n)`` plans as a distributed top-n (per-partition
    top-n, then a merge of ``n x partitions`` rows); the limit is the
    sampling feature itself."""
    return (candidates.select(F.col(id_col).alias("seed_id"))
            .orderBy(sample_order("seed_id", seed), "seed_id").limit(n))


def jaccard_topk(pairs: DataFrame, seeds: DataFrame, topn: int = RELEVANT_TOPN,
                 max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Top ``topn`` co-reviewed items per seed by Jaccard.

    Output ``(seed_id, item_id, inter, union_size, jaccard, rel_rank)``; self
    excluded; only items with at least one shared user (jaccard > 0); ties
    broken by item id.
    """
    seeds, seeds_small = checked_small(seeds.select("seed_id").distinct(), max_broadcast_rows)
    seed_users = (pairs.join(seeds, pairs.item_id == seeds.seed_id)
                  .select("seed_id", "user_id"))
    # Stream the full pair table past the seeds' users.  The seed side is
    # materialised once and broadcast when its checked size allows; otherwise
    # a salted join spreads a hot user's items over many tasks.
    seed_users, small = checked_small(seed_users, max_broadcast_rows)
    co = pairs.join(seed_users, "user_id") if small else salted_join(pairs, seed_users, ["user_id"])
    inter = (co.where(F.col("item_id") != F.col("seed_id"))
             .groupBy("seed_id", "item_id").agg(F.count(F.lit(1)).alias("inter")))
    deg = item_user_counts(pairs)
    seed_deg = deg.join(seeds, deg.item_id == seeds.seed_id).select(
        "seed_id", F.col("n_users").alias("n_seed"))
    # one row per seed: bounded by the (checked) seed count
    scored = (inter.join(F.broadcast(seed_deg) if seeds_small else seed_deg, "seed_id")
              .join(deg, "item_id")
              .withColumn("union_size", F.col("n_seed") + F.col("n_users") - F.col("inter"))
              .withColumn("jaccard", F.col("inter") / F.col("union_size")))
    w = Window.partitionBy("seed_id").orderBy(F.col("jaccard").desc(), F.col("item_id").asc())
    return (scored.withColumn("rel_rank", F.row_number().over(w).cast("long"))
            .where(F.col("rel_rank") <= topn)
            .select("seed_id", "item_id", F.col("inter").cast("long").alias("inter"),
                    F.col("union_size").cast("long").alias("union_size"),
                    F.round("jaccard", 6).alias("jaccard"), "rel_rank"))


def relevant_counts(relevance: DataFrame) -> DataFrame:
    """Relevant-list size per seed."""
    return relevance.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_rel"))
