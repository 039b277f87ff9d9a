"""Exact top-k over blocks of vectors: a block is read only by queries it can serve.

Vectors lie in blocks of bounded size.  A first round scores every query
against one block; its k-th score there is a floor that the query's final top k
cannot fall below.  A second round sends the query on to the blocks whose upper
bound reaches that floor, and to no other.  What bounds a block is the caller's
affair: largest weights per term (``sparse_index``), a centroid and a radius or the
largest norm (``dense_index``).

A group is some blocks, ``GROUP_BLOCKS`` of a large table, with a part of the queries that
read one of them; the blocks are repeated for further parts.  A query comes once to a
group, with the list of its blocks, and is scored against those alone, so vectors are
copied by groups and not by blocks.  Scores are computed in the task and at most k rows a
query leave it, so no pair of vectors is ever a row and a popular term, user
or block is not gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators.ranking import top_k

BLOCK_ITEMS = 1024
PART_QUERIES = 4096
GROUP_BLOCKS = 16          # blocks scored in one task, and parts of PART_QUERIES / 4 with them
#: Scores are compared after rounding; bounds get this much room for it.
SLACK = 1.0e-6
PAIRS = "seed_id long, item_id long, similarity double"

#: Block rows -> (query rows -> scores, one row a query and one column an item).
Scorer = Callable[[pa.Table], Callable[[pa.Table], np.ndarray]]


def block_numbers(df: DataFrame, order: list, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``df`` with a ``block`` for each run of ``block_items`` rows in ``order``.

    The rows are range-sorted; a block lies inside one partition.  Numbers hold for
    one materialised copy, so the caller writes it before use."""
    at = F.monotonically_increasing_id()
    row, part = F.pmod(at, F.lit(1 << 33)), F.shiftright(at, 33)
    return df.orderBy(*order).withColumn("block", F.shiftleft(part, 32) + F.floor(row / block_items).cast("long"))


def group_count(n_blocks: int, cores: int, one_each: bool = False) -> int:
    """Groups of blocks.  A query is copied for every group that it reads, so small tables have
    no more than keep the cores busy, unless queries read one block each."""
    return max(1, -(-n_blocks // GROUP_BLOCKS), min(n_blocks, (4 if one_each else 2) * cores))


def block_topk(routes: DataFrame, queries: DataFrame, blocks: DataFrame, scorer: Scorer, k: int,
               exclude_self: bool, digits: int | None, positive: bool, part_queries: int = PART_QUERIES,
               chunk: int = 32, one_each: bool = False) -> DataFrame:
    """Best ``k`` items of every routed (query, block): ``(seed_id, item_id, similarity)``.

    routes (seed_id, block, floor): rows under ``floor`` are left out, null is none;
    queries (seed_id, ...), blocks (block, item_id, ...): further columns are the scorer's.
    ``positive`` keeps only scores above zero; ``one_each`` says that routes have one block a query."""
    n_blocks = blocks.select("block").distinct().count()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    groups = group_count(n_blocks, cores, one_each)
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    asked = (routes.groupBy("seed_id", group.alias("group"))
             .agg(F.collect_list("block").alias("asked_blocks"), F.max(F.col("floor").cast("double")).alias("floor")))
    # blocks are copied by parts: few of them, of many queries each
    part_size = float(part_queries * max(1, GROUP_BLOCKS // 4))
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / F.lit(part_size)).cast("int").alias("parts"))
    left = (asked.join(parts, "group").join(queries, "seed_id")
            .withColumn("part", F.pmod(F.xxhash64("seed_id"), F.col("parts")).cast("int")).drop("parts"))
    # columns of their own: queries and blocks may come from one table
    right = (blocks.withColumn("group", group).join(parts, "group")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
             .select(F.col("group").alias("of_group"), F.col("part").alias("of_part"), F.col("block").alias("of_block"),
                     *(F.col(c).alias(c) for c in blocks.columns if c != "block")))
    schema = pa.schema([("seed_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])

    def one_block(asked: pa.Table, items: pa.Table, found: list) -> None:
        items = items.sort_by("item_id")
        item_ids = items.column("item_id").to_numpy()
        seeds = asked.column("seed_id").to_numpy()
        floors = np.nan_to_num(asked.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
        score = scorer(items)
        for at in range(0, len(seeds), chunk):
            s = score(asked.slice(at, chunk))
            if digits is not None:
                s = np.round(s, digits)
            drop = s < floors[at:at + chunk, None]
            if positive:
                drop |= s <= 0
            if exclude_self:
                drop |= seeds[at:at + chunk, None] == item_ids[None, :]
            s = np.where(drop, -np.inf, s)
            first = np.argsort(-s, axis=1, kind="stable")[:, :k]     # equal scores: smaller id
            best = np.take_along_axis(s, first, axis=1)
            row, col = np.nonzero(np.isfinite(best))
            found.append((seeds[at + row], item_ids[first[row, col]], best[row, col]))

    def run(asked: pa.Table, items: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and items.num_rows:
            wanted = asked.column("asked_blocks").combine_chunks()
            block = wanted.flatten().to_numpy()
            row = np.repeat(np.arange(asked.num_rows), wanted.value_lengths().to_numpy())
            order = np.argsort(block, kind="stable")
            block, row = block[order], row[order]
            own, asked = items.column("of_block").to_numpy(), asked.drop_columns(["asked_blocks"])
            for b in np.unique(own):
                low, high = np.searchsorted(block, b), np.searchsorted(block, b, "right")
                if low < high:
                    one_block(asked.take(pa.array(row[low:high])).combine_chunks(), items.filter(pa.array(own == b)).combine_chunks(), found)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        order = np.lexsort((columns[1], -columns[2], columns[0]))
        seed = columns[0][order]
        order = order[np.arange(len(seed)) - np.searchsorted(seed, seed) < k]     # the best k of all blocks here
        return pa.table([pa.array(c[order], t.type) for c, t in zip(columns, schema)], schema=schema)

    return left.groupBy("group", "part").cogroup(right.groupBy("of_group", "of_part")).applyInArrow(run, PAIRS)


def floors(pairs: DataFrame, k: int) -> DataFrame:
    """(seed_id, floor): the k-th best similarity so far, for seeds that have k."""
    return (top_k(pairs, ["seed_id"], "similarity", "item_id", k, digits=None)
            .where(F.col("rank") == k).select("seed_id", F.col("similarity").alias("floor")))


def merged(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The final top k of both rounds: ``(seed_id, item_id, similarity, rank)``."""
    return (top_k(first.unionByName(second), ["seed_id"], "similarity", "item_id", k, digits=None)
            .select("seed_id", "item_id", "similarity", "rank"))


# ------------------------------------------------------ equal vectors as one

def with_class(df: DataFrame, *keys) -> DataFrame:
    """``df`` with ``rep``, the smallest item_id of the rows that agree in ``keys``.

    Equal rows are compared by 128 bits of hashes; a class may hold most of the rows."""
    hashed = df.withColumn("h1", F.xxhash64(*keys)).withColumn("h2", F.xxhash64(F.lit(1), *keys))
    reps = hashed.groupBy("h1", "h2").agg(F.min("item_id").alias("rep"))
    return hashed.join(reps, ["h1", "h2"]).drop("h1", "h2")


def members_topk(members: DataFrame, pairs: DataFrame, k: int, own: float = 1.0) -> DataFrame:
    """Top k of every item from the top k of its class.

    members (item_id, rep); pairs (seed_id, item_id, similarity) between
    representatives.  A class's list holds its k + 1 best items: its own smallest ids at
    similarity ``own`` and the smallest ids of similar classes.  A member takes the list
    without itself, so nothing grows with the square of a class.  An id that comes in c rows
    has one list; as in a join of rows, an item of m rows stands c * c * m times in it."""
    members = members.groupBy("item_id", "rep").agg(F.count("*").alias("times")).withColumn("same", F.lit(0))
    smallest = top_k(members, ["rep"], "same", "item_id", k + 1, digits=None).select("rep", "item_id", "times")
    other = smallest.select(F.col("rep").alias("item_rep"), F.col("item_id").alias("member"), "times")
    listed = (pairs.select(F.col("seed_id").alias("rep"), F.col("item_id").alias("item_rep"), "similarity")
              .join(other, "item_rep").select("rep", F.col("member").alias("item_id"), "times", "similarity")
              .unionByName(smallest.withColumn("similarity", F.lit(float(own)))))
    lists = (top_k(listed, ["rep"], "similarity", "item_id", k + 1, digits=None)
             .groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "similarity", F.col("times").alias("m")))).alias("best")))
    rest = F.filter("best", lambda b: b["item_id"] != F.col("seed_id"))
    copies = lambda b: F.array_repeat(b, F.least(F.col("times") * F.col("times") * b["m"], F.lit(k)).cast("int"))
    return (members.withColumnRenamed("item_id", "seed_id").join(lists, "rep")
            .select("seed_id", F.posexplode(F.slice(F.flatten(F.transform(rest, copies)), 1, k)).alias("at", "b"))
            .select("seed_id", F.col("b.item_id").alias("item_id"), F.col("b.similarity").alias("similarity"),
                    (F.col("at") + 1).cast("long").alias("rank")))
