"""Sparse vectors in blocks with the largest weight of each term.

``all_items_topk`` is the exact similarity join of a TF-IDF table with itself, the
top k of every item; ``search`` answers free-text queries.  Both read a block only
where the sum of (own weight x largest weight in the block) reaches the k-th
score found so far.

The join also drops terms from a vector before it looks for blocks: terms are
taken from the most frequent on while neither their weights times the largest weight of
the term anywhere nor their norm reach the k-th score.  Two items that share none of
the remaining terms cannot be in each other's lists, so the frequent terms of
similar items never meet the index.  The fewer similar items there are, the lower
the k-th score and the more blocks are read: the work lies between one block an item
and all of them, and no pair becomes a row either way.

Equal vectors are one class (see ``blocks.members_topk``).  Blocks follow the
most frequent term of an item and then a min-hash of its terms, so similar items
meet in the first round.  The vocabulary is bounded by ``max_features``; its largest
weights are the only thing sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators import blocks as B
from recolens.operators.ids import dense_ids
from recolens.operators.ranking import top_k
from recolens.operators.similarity import SCORE_DIGITS
from recolens.operators.tfidf import TfidfModel
from recolens.session import cut_lineage, removed_folder, scratch_folder, written

WAVE_GROUPS = 3            # groups of blocks there are for each wave of queries


@dataclass
class SparseIndex:
    terms: DataFrame      # (term, tid), the most frequent first
    vectors: DataFrame    # (block, item_id, tids, ws), unit vectors, tids ascending
    maxima: DataFrame     # (tid, block, most)
    n_terms: int


def term_numbers(model: TfidfModel) -> DataFrame:
    """(term, tid): terms numbered by falling document frequency."""
    return cut_lineage(dense_ids(model.vocab.withColumn("rare", -F.col("df")), "term", "tid", order_col="rare"))


def unit_vectors(weights: DataFrame, terms: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, tids, ws, same) of (id, term, w): one row a vector, its norm 1, tids ascending;
    ``same`` is a hash of the entries as they came, 128 bits."""
    # the norm is an aggregate: as an expression it would be computed for every entry
    entries = (weights.join(terms, "term").groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("e"),
                    F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    return (entries.where("norm > 0")
            .select(id_col, F.transform("e", lambda x: x["tid"]).alias("tids"),
                    F.transform("e", lambda x: x["w"] / F.col("norm")).alias("ws"),
                    F.array(F.xxhash64("e"), F.xxhash64(F.lit(1), "e")).alias("same")))


def build(vectors: DataFrame, terms: DataFrame, n_terms: int, block_items: int = B.BLOCK_ITEMS) -> SparseIndex:
    """Blocks of similar vectors and their largest weights, both materialised."""
    near = F.array_min(F.transform("tids", lambda t: F.xxhash64(t)))
    placed = written(B.block_numbers(vectors.select("item_id", "tids", "ws"), [F.col("tids")[0], near, "item_id"], block_items), "placed")
    maxima = (placed.select("block", F.explode(F.arrays_zip("tids", "ws")).alias("e"))
              .groupBy(F.col("e.tids").alias("tid"), "block").agg(F.max("e.ws").alias("most")))
    return SparseIndex(terms, placed, written(maxima, "maxima"), n_terms)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), column.value_lengths().to_numpy()


def scorer(items: pa.Table):
    """Inner products of query vectors with a block, by its postings in term order."""
    tids, sizes = _lists(items.column("tids"))
    order = np.argsort(tids, kind="stable")
    known, first, count = np.unique(tids[order], return_index=True, return_counts=True)
    holder = np.repeat(np.arange(len(sizes)), sizes)[order]
    weight = _lists(items.column("ws"))[0][order]

    def score(asked: pa.Table) -> np.ndarray:
        terms, lengths = _lists(asked.column("tids"))
        own = _lists(asked.column("ws"))[0]
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        n = np.where(known[at] == terms, count[at], 0)
        place = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query = np.repeat(np.repeat(np.arange(len(lengths)), lengths), n)
        return np.bincount(query * len(sizes) + holder[place], np.repeat(own, n) * weight[place],
                           len(lengths) * len(sizes)).reshape(len(lengths), len(sizes))
    return score


def needed_terms(vectors: DataFrame, index: SparseIndex) -> DataFrame:
    """(seed_id, floor, rest, tids, ws): the terms by which a vector must meet another one
    to reach ``floor``; the others together add at most ``rest``."""
    most = np.zeros(index.n_terms)
    for r in index.maxima.groupBy("tid").agg(F.max("most").alias("most")).collect():   # <= max_features rows
        most[r.tid] = r.most
    shared = vectors.sparkSession.sparkContext.broadcast(most)
    schema = pa.schema([("seed_id", pa.int64()), ("floor", pa.float64()), ("rest", pa.float64()),
                        ("tids", pa.list_(pa.int32())), ("ws", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seed, floor, tids, ws in zip(*(batch.column(n) for n in ("seed_id", "floor", "tids", "ws"))):
                floor = floor.as_py() or 0.0
                tids, ws = tids.values.to_numpy(), ws.values.to_numpy()
                bound = np.minimum(np.cumsum(ws * shared.value[tids]), np.sqrt(np.cumsum(ws * ws)))
                n = int(np.searchsorted(bound, floor - B.SLACK))
                out.append((seed.as_py(), floor, float(bound[n - 1]) if n else 0.0, tids[n:], ws[n:]))
            if out:
                yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return vectors.select("seed_id", F.col("floor").cast("double"), "tids", "ws").mapInArrow(
        run, "seed_id long, floor double, rest double, tids array<int>, ws array<double>")


def block_bounds(needed: DataFrame, index: SparseIndex) -> DataFrame:
    """(seed_id, block, floor, bound): what a vector can score in a block at most."""
    rows = needed.select("seed_id", "floor", "rest", F.explode(F.arrays_zip("tids", "ws")).alias("e"))
    return (rows.select("seed_id", "floor", "rest", F.col("e.tids").alias("tid"), F.col("e.ws").alias("w"))
            .join(index.maxima, "tid").groupBy("seed_id", "block")
            .agg((F.sum(F.col("w") * F.col("most")) + F.max("rest")).alias("bound"), F.max("floor").alias("floor")))


def _topk(routes, queries, index, k, exclude_self, part_queries, one_each=False):
    return B.block_topk(routes, queries, index.vectors, scorer, k, exclude_self, SCORE_DIGITS, True, part_queries, one_each=one_each)


def vectors_topk(index: SparseIndex, k: int, part_queries: int = B.PART_QUERIES) -> DataFrame:
    """Top k of every indexed vector among the others: ``(seed_id, item_id, similarity, rank)``.

    The second round goes by waves of queries, one for each ``WAVE_GROUPS`` groups
    of blocks: what a wave
    makes of (query, block) rows and copies of vectors is gone before the next one, so disk
    grows with the vectors and not with queries times blocks."""
    spark = index.vectors.sparkSession
    queries = index.vectors.select(F.col("item_id").alias("seed_id"), "tids", "ws")
    home = index.vectors.select(F.col("item_id").alias("seed_id"), "block", F.lit(None).cast("double").alias("floor"))
    first = written(_topk(home, queries, index, k, True, part_queries, True), "first")
    floors = written(B.floors(first, k), "floors")
    groups = B.group_count(index.vectors.select("block").distinct().count(), spark.sparkContext.defaultParallelism)
    waves = max(1, -(-groups // WAVE_GROUPS))
    found = first
    for at in range(waves):
        mine = F.pmod(F.xxhash64("seed_id"), F.lit(waves)) == at
        asked = queries.where(mine)
        routes = (block_bounds(needed_terms(asked.join(floors, "seed_id", "left"), index), index)
                  .where(F.col("bound") >= F.col("floor") - B.SLACK)
                  .join(home.where(mine).select("seed_id", "block"), ["seed_id", "block"], "left_anti")
                  .select("seed_id", "block", "floor"))
        folder = scratch_folder(spark, "routes")
        more = _topk(written(routes, "routes", folder), asked, index, k, True, part_queries)
        found = found.unionByName(written(top_k(more, ["seed_id"], "similarity", "item_id", k, digits=None).drop("rank"), "found"))
        removed_folder(spark, folder)
    return (top_k(found, ["seed_id"], "similarity", "item_id", k, digits=None)
            .select("seed_id", "item_id", "similarity", "rank"))


def all_items_topk(weights: DataFrame, model: TfidfModel, k: int, block_items: int = B.BLOCK_ITEMS,
                   part_queries: int = B.PART_QUERIES, spent: str | None = None) -> DataFrame:
    """J5/K2 for all items: the exact top ``k`` of every item of ``weights`` (item_id,
    term, w) by cosine, above zero, equal ones by id: ``(seed_id, item_id, similarity, rank)``.
    ``spent`` is a folder that none but ``weights`` is read from; it goes once they are."""
    terms = term_numbers(model)
    spark = weights.sparkSession
    folder = scratch_folder(spark, "classes")
    classed = written(B.with_class(unit_vectors(weights, terms), "same").drop("same"), "classes", folder)
    if spent:
        removed_folder(spark, spent)
    members = written(classed.select("item_id", "rep"), "members")
    index = build(classed.where("item_id = rep").select("item_id", "tids", "ws"), terms, terms.count(), block_items)
    removed_folder(spark, folder)
    return B.members_topk(members, written(vectors_topk(index, k, part_queries), "found"), k)


@dataclass
class SearchResult:
    top: DataFrame       # (seed_id, item_id, similarity, rank)
    routes: DataFrame    # (seed_id, block): the blocks that were read
    bounds: DataFrame    # (seed_id, block, bound): the blocks that share a term


def search(query_weights: DataFrame, index: SparseIndex, k: int, part_queries: int = B.PART_QUERIES) -> SearchResult:
    """Exact top ``k`` items of every query (seed_id, term, w), above zero.

    The block of the highest bound comes first; then those whose bound reaches the
    k-th score in it."""
    queries = written(unit_vectors(query_weights, index.terms, "seed_id").drop("same"), "queries")
    bounds = written(block_bounds(queries.withColumn("floor", F.lit(None).cast("double"))
                                  .withColumn("rest", F.lit(0.0)), index).drop("floor"), "bounds")
    home = (bounds.groupBy("seed_id").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
            .withColumn("floor", F.lit(None).cast("double")))
    first = written(_topk(home, queries, index, k, False, part_queries, True), "first")
    more = written(
        bounds.join(home.select("seed_id", "block"), ["seed_id", "block"], "left_anti")
        .join(B.floors(first, k), "seed_id", "left")
        .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - B.SLACK)).select("seed_id", "block", "floor"), "routes")
    top = B.merged(first, _topk(more, queries, index, k, False, part_queries), k)
    return SearchResult(top, home.select("seed_id", "block").unionByName(more.select("seed_id", "block")), bounds)
