"""Jaccard overlap of every item with every other (J4, K5, A17), top k, exact.

Users are split by degree.  A light user's items are joined pairwise; a heavy user
(more items than the square root of all pairs, so there are at most that many) would
make pairs by the square of its items, so heavy users become bit positions and an
item's heavy users a bitmap: 64-bit words by word number.

* Pairs with a light user in common are counted in tasks and not shuffled.  Items are dealt
  into blocks as seeds; a user's whole list of items comes once to every block that holds one
  of them, and of each seed only the partners that can be among its best ``k`` leave the
  task.  (A seed with more partners than a task should hold is counted by rows.)  The heavy
  overlap of those that left is the bit count of the words both have.
* Pairs with heavy users alone in common never become rows.  Such a pair's overlap
  is at most (heavy users of the item) / (users of the item), so only items for which that
  reaches their k-th overlap so far look for them, in blocks of bitmaps
  (``operators.blocks``) whose united words promise enough common bits.

Items with the same set of users are one class.  A pair may be found both ways; the
bitmaps alone see no light user, so the larger value is the true one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators import blocks as B
from recolens.operators.ids import dense_ids
from recolens.operators.ranking import top_k
from recolens.session import cut_lineage, written

#: Users of fewer items than this are light however few pairs there are.
LEAST_HEAVY = 64
#: Items of users' lists that a block of seeds reads at most, on average.
BLOCK_ENTRIES = 1 << 26
#: Partners, once for each common user, that are counted at a time; seeds of more are counted by rows.
PARTNERS_AT_ONCE = 1 << 22


def item_classes(pairs: DataFrame) -> DataFrame:
    """(item_id, n_users, rep): items and the smallest item with the same set of users.

    Sets are compared by their size and 128 bits of order-free hashes."""
    sets = pairs.groupBy("item_id").agg(F.count("*").alias("n_users"), F.bit_xor(F.xxhash64("user_id")).alias("a"),
                                        F.bit_xor(F.xxhash64(F.lit(1), F.col("user_id"))).alias("b"))
    reps = sets.groupBy("n_users", "a", "b").agg(F.min("item_id").alias("rep"))
    return sets.join(reps, ["n_users", "a", "b"]).select("item_id", "n_users", "rep")


def heavy_users(pairs: DataFrame, heavy_degree: int) -> DataFrame:
    """(user_id, bit): users of more than ``heavy_degree`` items, numbered from 0."""
    heavy = pairs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > heavy_degree)
    return cut_lineage(dense_ids(heavy, "user_id", "bit"))


def item_bitmaps(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """(item_id, words map<int, long>, n_heavy) of the items that heavy users have."""
    return (pairs.join(heavy, "user_id")
            .groupBy("item_id", F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
            .groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
                                    F.sum(F.bit_count("bits")).alias("n_heavy")))


def common_bits(a: str, b: str):
    """Bits that two bitmaps share (a missing bitmap has none)."""
    return F.coalesce(F.aggregate(F.map_entries(a), F.lit(0).cast("long"), lambda n, e: n + F.coalesce(
        F.bit_count(e["value"].bitwiseAND(F.try_element_at(b, e["key"]))).cast("long"), F.lit(0).cast("long"))),
        F.lit(0).cast("long"))


def light_overlaps(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """(a, b, light): items a < b and the light users they share, every pair a row: for small tables and tests."""
    light = pairs.join(heavy, "user_id", "left_anti")
    left, right = light.select("user_id", F.col("item_id").alias("a")), light.select("user_id", F.col("item_id").alias("b"))
    return left.join(right, "user_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("light"))


def numbered_items(items: DataFrame) -> DataFrame:
    """``items`` with a ``number`` from 0 in the order of (n_users, n_heavy, item_id)."""
    order = items.withColumn("order", F.struct("n_users", "n_heavy"))
    return cut_lineage(items.join(dense_ids(order, "item_id", "number", "order"), "item_id"))


class Degrees:
    """Users and heavy users of items by number.  Both are steps over the numbers, at most about
    (3 pairs) ** (2/3) / 2 of them."""

    def __init__(self, numbered: DataFrame):
        steps = (numbered.groupBy("n_users", "n_heavy").agg(F.min("number").alias("first")).toArrow().sort_by("first"))
        self.first, self.users, self.heavy = (steps.column(c).to_numpy().astype(np.int64) for c in ("first", "n_users", "n_heavy"))

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, number, "right") - 1
        return self.users[at], self.heavy[at]


def _first_of_each(*keys: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the first ``k`` of its keys; equal keys stand together."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.concatenate([[True], np.any([key[1:] != key[:-1] for key in keys], axis=0)])
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def likely_partners(seed: np.ndarray, item: np.ndarray, light: np.ndarray, degrees: Degrees, k: int) -> np.ndarray:
    """Rows, of sorted (seed, item), that can be among the best ``k`` of their seed.

    Items without heavy users have their exact overlap here, and of as many common users the first
    by number are the best.  Of the others heavy users can add what both items have of them."""
    (own, own_heavy), (users, heavy) = degrees.of(seed), degrees.of(item)
    order = np.lexsort((light, seed)) if light.max(initial=1) > 1 else np.arange(len(seed))  # stable: items stay in order
    exact = order[heavy[order] == 0]
    rows = np.concatenate([exact[_first_of_each(seed[exact], light[exact], k=k)], np.flatnonzero(heavy > 0)])
    both = light[rows] + np.minimum(own_heavy, heavy)[rows]
    total = (own + users)[rows]
    least, most = light[rows] / (total - light[rows]), both / (total - both)
    order = np.lexsort((-least, seed[rows]))
    rows, least, most = rows[order], least[order], most[order]
    last = _first_of_each(seed[rows], k=k) & ~_first_of_each(seed[rows], k=k - 1)  # the k-th of its seed, if there is one
    floors = dict(zip(seed[rows[last]].tolist(), least[last].tolist()))
    return rows[most >= np.array([floors.get(x, 0.0) for x in seed[rows].tolist()])]


def _partners(degrees: Degrees, n_items: int, blocks: int, by_rows: np.ndarray, k: int):
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("light", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("items").combine_chunks()
        many = lists.value_lengths().to_numpy().astype(np.int64)
        starts, items = np.cumsum(many) - many, lists.flatten().to_numpy()
        at = np.flatnonzero(items % blocks == table.column("block")[0].as_py())
        at = at[~np.isin(items[at], by_rows)]
        at = at[np.argsort(items[at], kind="stable")]
        seeds, of = items[at].astype(np.int64), np.searchsorted(starts, at, "right") - 1
        many, starts = many[of], starts[of]
        ends, last = np.cumsum(many), np.append(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, len(seeds))
        out, done = [], 0
        while done < len(seeds):  # whole seeds
            room = int(np.searchsorted(ends, ends[done] - many[done] + PARTNERS_AT_ONCE, "right"))
            upto = int(last[max(np.searchsorted(last, room, "right") - 1, np.searchsorted(last, done, "right"))])
            m = many[done:upto]
            partner = items[np.arange(m.sum()) + np.repeat(starts[done:upto] - (np.cumsum(m) - m), m)]
            pair, light = np.unique(np.repeat(seeds[done:upto], m) * n_items + partner, return_counts=True)
            seed, item = np.divmod(pair, n_items)
            other = seed != item
            seed, item, light = seed[other], item[other], light[other]
            kept = likely_partners(seed, item, light, degrees, k)
            out.append(pa.table([pa.array(seed[kept].astype(np.int32)), pa.array(item[kept].astype(np.int32)),
                                 pa.array(light[kept].astype(np.int64))], schema=schema))
            done = upto
        return pa.concat_tables([schema.empty_table(), *out])
    return run


def light_partners(pairs: DataFrame, heavy: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    """(a, b, light): for every item a, by number, the items b that share ``light`` light users with it
    and can be among its best ``k``."""
    coded = (pairs.join(heavy, "user_id", "left_anti").join(numbered.select("item_id", "number"), "item_id"))
    lists = written(coded.groupBy("user_id").agg(F.collect_list("number").alias("items")).where(F.size("items") > 1)
                    .select("items"), "user-lists")
    size = F.size("items").cast("long")
    partners = lists.agg(F.sum(size * size)).first()[0] or 0
    blocks = max(-(-partners // BLOCK_ENTRIES), 2 * pairs.sparkSession.sparkContext.defaultParallelism)
    # at most partners / PARTNERS_AT_ONCE numbers
    many = (lists.select(F.explode("items").alias("a"), size.alias("n")).groupBy("a").agg(F.sum("n").alias("n"))
            .where(F.col("n") > PARTNERS_AT_ONCE).select("a").toArrow().column("a").to_numpy())
    dealt = lists.select(F.explode(F.array_distinct(F.transform("items", lambda i: i % F.lit(blocks).cast("int")))).alias("block"), "items")
    found = dealt.groupBy("block").applyInArrow(_partners(Degrees(numbered), numbered.count(), int(blocks), many, k),
                                                "a int, b int, light long")
    if not len(many):
        return found
    asked = lists.sparkSession.createDataFrame([(int(a),) for a in many], "a int")
    rows = (lists.select(F.explode("items").alias("a"), "items").join(F.broadcast(asked), "a")
            .select("a", F.explode("items").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("light")))
    return found.unionByName(rows)


def bitmap_scorer(items: pa.Table):
    """Jaccard by heavy users alone, bit counts of the words that stand in the block."""
    def flat(table):
        at = [table.column(c).combine_chunks() for c in ("word", "bits")]
        return (np.repeat(np.arange(table.num_rows), at[0].value_lengths().to_numpy()),
                at[0].flatten().to_numpy(), at[1].flatten().to_numpy().view(np.uint64))

    row, word, bits = flat(items)
    known = np.unique(word)

    def matrix(table, row, word, bits):
        out = np.zeros((table.num_rows, len(known)), np.uint64)
        at = np.minimum(np.searchsorted(known, word), len(known) - 1)
        here = known[at] == word
        out[row[here], at[here]] = bits[here]
        return out

    own, users = matrix(items, row, word, bits), items.column("n_users").to_numpy()

    def score(asked: pa.Table) -> np.ndarray:
        theirs, n = matrix(asked, *flat(asked)), asked.column("n_users").to_numpy()
        shared = np.stack([np.bitwise_count(own & t).sum(axis=1, dtype=np.int64) for t in theirs])
        return shared / (users[None, :] + n[:, None] - shared)
    return score


def heavy_only(items: DataFrame, floors: DataFrame, k: int, block_items: int, part_queries: int) -> DataFrame:
    """Best ``k`` by heavy users alone, for the items that these can still serve."""
    flat = (items.where("n_heavy > 0").select("item_id", "n_users", "n_heavy", F.map_keys("words").alias("word"),
                                              F.map_values("words").alias("bits")))
    placed = cut_lineage(B.block_numbers(flat, ["n_users", "item_id"], block_items))
    words = placed.select("block", "item_id", "n_users", F.explode(F.arrays_zip("word", "bits")).alias("w"))
    united = words.groupBy("block", F.col("w.word").alias("word")).agg(F.bit_or("w.bits").alias("united"))
    least = placed.groupBy("block").agg(F.min("n_users").alias("least_users"))
    open_items = (placed.join(floors, placed.item_id == floors.seed_id, "left").drop("seed_id")
                  .where(F.col("floor").isNull() | (F.col("n_heavy") / F.col("n_users") >= F.col("floor"))))
    asked = open_items.select("item_id", "floor", F.col("n_users").alias("own"), F.explode(F.arrays_zip("word", "bits")).alias("w"))
    routes = (asked.withColumn("word", F.col("w.word")).join(united, "word")
              .groupBy("item_id", "block").agg(
                  F.sum(F.bit_count(F.col("w.bits").bitwiseAND(F.col("united")))).alias("shared"),
                  F.max("floor").alias("floor"), F.max("own").alias("own"))
              .join(least, "block")
              .where((F.col("shared") > 0) & (F.col("floor").isNull() | (
                  F.col("shared") / F.greatest("own", "least_users") >= F.col("floor"))))
              .select(F.col("item_id").alias("seed_id"), "block", "floor"))
    queries = placed.select(F.col("item_id").alias("seed_id"), "n_users", "word", "bits")
    return B.block_topk(cut_lineage(routes), queries, placed.drop("n_heavy"), bitmap_scorer, k, True, None, True, part_queries)


def all_items_topk(pairs: DataFrame, k: int, heavy_degree: int | None = None, block_items: int = B.BLOCK_ITEMS,
                   part_queries: int = B.PART_QUERIES) -> DataFrame:
    """The exact top ``k`` items of every item by Jaccard, above zero, equal ones by id:
    ``(seed_id, item_id, similarity, rank)``.  pairs (user_id, item_id) are distinct."""
    classes = cut_lineage(item_classes(pairs))
    one_each = cut_lineage(pairs.join(classes.where("item_id = rep").select("item_id"), "item_id", "left_semi"))
    if heavy_degree is None:
        heavy_degree = max(LEAST_HEAVY, math.isqrt(one_each.count()))
    heavy = heavy_users(one_each, heavy_degree)
    items = classes.where("item_id = rep").select("item_id", "n_users")
    any_heavy = not heavy.isEmpty()
    if any_heavy:
        items = cut_lineage(items.join(item_bitmaps(one_each, heavy), "item_id", "left"))
    n_heavy = F.coalesce("n_heavy", F.lit(0).cast("long")) if any_heavy else F.lit(0).cast("long")
    numbered = numbered_items(items.withColumn("n_heavy", n_heavy))
    side = lambda c: numbered.select(*(F.col(x).alias(c if x == "number" else f"{c}_{x}") for x in numbered.columns))
    met = light_partners(one_each, heavy, numbered, k).join(side("a"), "a").join(side("b"), "b")
    inter = F.col("light") + (common_bits("a_words", "b_words") if any_heavy else 0)
    found = met.withColumn("inter", inter).select(
        F.col("a_item_id").alias("seed_id"), F.col("b_item_id").alias("item_id"),
        (F.col("inter") / (F.col("a_n_users") + F.col("b_n_users") - F.col("inter"))).alias("similarity"))
    best = cut_lineage(top_k(found, ["seed_id"], "similarity", "item_id", k, digits=None).drop("rank"))
    if any_heavy:
        more = heavy_only(items, B.floors(best, k), k, block_items, part_queries)
        best = (best.unionByName(more).groupBy("seed_id", "item_id").agg(F.max("similarity").alias("similarity")))
        best = top_k(best, ["seed_id"], "similarity", "item_id", k, digits=None).drop("rank")
    return B.members_topk(classes.select("item_id", "rep"), best, k)
