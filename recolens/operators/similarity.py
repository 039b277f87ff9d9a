"""Cosine similarity top-k.

Sparse (TF-IDF): the weight table is gathered to one row an item, its entries cut to
the seeds' terms and its norm taken over all of them.  The seeds' vectors, size-checked,
are shipped once to every task, which scores its items against all seeds and keeps each
seed's best ``k``, so no (seed, item) pair is a row and at most ``seeds x k`` rows leave a
task.  A seed set too large for that is joined on ``term`` with salts.  Items sharing no
term with a seed score 0 and are not listed (the dense reference lists them at the tail).

Dense (embeddings): the seed matrix (``n_seeds x dim``, size-checked) is
shipped once to every task; ``mapInPandas`` multiplies each Arrow batch of
items by it and keeps, per seed, only the rows that can still reach the top
k of that batch (ties included), so the shuffle carries at most
``seeds x k`` rows per batch.  A final window picks the global top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators.joins import DEFAULT_BROADCAST_ROWS, checked_small, fits, salted_join
from recolens.operators.ranking import top_k
from recolens.session import cut_lineage

SCORE_DIGITS = 6
MAX_TASK_SEEDS = 20_000      # seeds that every task scores its items against
SCORE_CELLS = 1 << 22        # scores and products held at once in a task


def cosine_topk_for_seeds(weights: DataFrame, seeds: DataFrame, k: int,
                          exclude_self: bool = True,
                          max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """K1/K2/K3 over un-normalised weights ``(item_id, term, w)``.

    Output ``(seed_id, item_id, similarity, rank)``, ``rank`` 1-based by
    similarity DESC then item id."""
    seeds, _ = checked_small(seeds.select("seed_id").distinct(), max_broadcast_rows)
    seed_w = (weights.join(seeds, weights.item_id == seeds.seed_id)
              .select("seed_id", "term", "w"))
    return cosine_topk_for_queries(seed_w, weights, k, exclude_self, max_broadcast_rows)


def cosine_topk_for_queries(query_w: DataFrame, weights: DataFrame, k: int,
                            exclude_self: bool = False,
                            max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Top-k items for each query vector ``(seed_id, term, w)``.

    The query side is materialised once and size-checked; when small every task has it
    and scores whole items, else a salted join spreads each term over many tasks."""
    q, small = checked_small(query_w.select("seed_id", "term", F.col("w").alias("w_q")),
                             max_broadcast_rows)
    kinds = {dict(q.dtypes)["seed_id"], dict(weights.dtypes)["item_id"]}
    if small and kinds <= {"int", "bigint"} and q.select("seed_id").distinct().count() <= MAX_TASK_SEEDS:
        return _scored_in_tasks(q, weights, k, exclude_self)
    joined = weights.join(q, "term") if small else salted_join(weights, q, ["term"])
    dots = joined.groupBy("seed_id", "item_id").agg(F.sum(F.col("w") * F.col("w_q")).alias("dot"))
    if exclude_self:
        dots = dots.where(F.col("item_id") != F.col("seed_id"))
    qn = q.groupBy("seed_id").agg(F.sqrt(F.sum(F.col("w_q") * F.col("w_q"))).alias("q_norm"))
    inorm = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("i_norm"))
    scored = (dots.join(F.broadcast(qn) if small else qn, "seed_id").join(inorm, "item_id")
              .withColumn("similarity", F.round(F.col("dot") / (F.col("q_norm") * F.col("i_norm")),
                                                SCORE_DIGITS))
              .where(F.col("similarity") > 0))
    return (top_k(scored, ["seed_id"], "similarity", "item_id", k, digits=None)
            .select("seed_id", "item_id", "similarity", "rank"))


class _BestOfSeeds:
    """The ``k`` best (similarity, smaller item id) of each seed among the scores seen."""

    def __init__(self, n_seeds: int, k: int):
        self.k, self.floor = k, np.zeros(n_seeds)
        self.last = np.full(n_seeds, np.iinfo(np.int64).min)     # zero never enters
        self.seed, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, items: np.ndarray) -> None:
        """``scores`` has one row an item and one column a seed."""
        row, col = np.nonzero((scores > self.floor) | ((scores == self.floor) & (items[:, None] < self.last)))
        if not len(row):
            return
        seed = np.concatenate([self.seed, col])
        item = np.concatenate([self.item, items[row]])
        score = np.concatenate([self.score, scores[row, col]])
        order = np.lexsort((item, -score, seed))
        seed, item, score = seed[order], item[order], score[order]
        place = np.arange(len(seed)) - np.searchsorted(seed, seed)
        kept = place < self.k
        self.seed, self.item, self.score = seed[kept], item[kept], score[kept]
        full = place[kept] == self.k - 1
        self.floor[self.seed[full]], self.last[self.seed[full]] = self.score[full], self.item[full]


def _scored_in_tasks(q: DataFrame, weights: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Top k of the queries (seed_id, term, w_q): items are scored where their vectors lie."""
    spark = weights.sparkSession
    terms = cut_lineage(q.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    rows = (q.where(F.col("seed_id").isNotNull()).join(F.broadcast(terms), "term")
            .select(F.col("seed_id").cast("long"), "tid", "w_q").toArrow())      # within checked_small's bounds
    seeds, seed = np.unique(rows.column("seed_id").to_numpy(), return_inverse=True)
    w_q, known = rows.column("w_q").to_numpy(), np.unique(rows.column("tid").to_numpy())
    q_norm = np.sqrt(np.bincount(seed, w_q * w_q, len(seeds)))
    order = np.argsort(rows.column("tid").to_numpy(), kind="stable")
    first = np.searchsorted(rows.column("tid").to_numpy()[order], known)
    count = np.diff(np.append(first, len(order)))
    shared = spark.sparkContext.broadcast((seeds, q_norm, known, first, count, seed[order], w_q[order]))
    entry = F.when(F.col("tid").isNotNull(), F.struct("tid", "w"))
    vectors = (weights.where(F.col("item_id").isNotNull()).join(F.broadcast(terms), "term", "left")
               .groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(entry).alias("e"))
               .where(F.size("e") > 0)
               .select(F.col("item_id").cast("long"), "norm", F.col("e.tid").alias("tids"), F.col("e.w").alias("ws")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, q_norm, known, first, count, of_seed, of_weight = shared.value
        best = _BestOfSeeds(len(seeds), k)
        for b in batches:
            items, norm = b.column(0).to_numpy(), b.column(1).to_numpy()
            sizes = b.column(2).value_lengths().to_numpy()
            at, w = np.searchsorted(known, b.column(2).flatten().to_numpy()), b.column(3).flatten().to_numpy()
            n, ends = count[at], np.cumsum(sizes)
            work = np.append(0, np.cumsum(n))[ends] + ends + np.arange(1, len(items) + 1) * len(seeds)
            piece = work // SCORE_CELLS
            for here in np.split(np.arange(len(items)), np.nonzero(np.diff(piece))[0] + 1):
                if not len(here):
                    continue
                low, high = ends[here[0]] - sizes[here[0]], ends[here[-1]]
                m, start = n[low:high], first[at[low:high]]
                place = np.repeat(start - (np.cumsum(m) - m), m) + np.arange(m.sum())
                row = np.repeat(np.repeat(np.arange(len(here)), sizes[here]), m)
                dots = np.bincount(row * len(seeds) + of_seed[place], np.repeat(w[low:high], m) * of_weight[place],
                                   len(here) * len(seeds)).reshape(len(here), len(seeds))
                scores = np.round(dots / (norm[here, None] * q_norm), SCORE_DIGITS)
                if exclude_self:
                    scores[items[here, None] == seeds] = 0
                best.add(scores, items[here])
        yield pa.record_batch([pa.array(seeds[best.seed]), pa.array(best.item), pa.array(best.score)],
                              names=["seed_id", "item_id", "similarity"])

    found = vectors.mapInArrow(run, "seed_id long, item_id long, similarity double")
    return (top_k(found, ["seed_id"], "similarity", "item_id", k, digits=None)
            .select(F.col("seed_id").cast(dict(q.dtypes)["seed_id"]), F.col("item_id").cast(dict(weights.dtypes)["item_id"]),
                    "similarity", "rank"))


# ------------------------------------------------------------------- dense

def dense_topk_blocked(queries: DataFrame, items: DataFrame, k: int, cosine: bool = True,
                       exclude_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """Exact top-k of ``items(item_id, embedding)`` for every row of
    ``queries(seed_id, embedding)`` by cosine (or raw dot product) - the form
    for query sets too large to broadcast.

    Both sides are hashed into blocks of about ``block_rows`` vectors; every
    (query block, item block) pair is one cogroup group scored by one matrix
    product, and only each query's best ``k`` of that block (ties kept)
    leave the task; a windowed top-k merges the blocks.  Memory per task is
    two blocks and one score block; no pair is emitted as a row.
    Output ``(seed_id, item_id, similarity, rank)``."""
    nq = max(1, queries.count())
    ni = max(1, items.count())
    bq, bi = -(-nq // block_rows), -(-ni // block_rows)
    q = (queries.select(F.col("seed_id").alias("qid"), F.col("embedding").alias("qv"),
                        F.pmod(F.xxhash64("seed_id"), F.lit(bq)).alias("qb"))
         .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(bi - 1)))))
    it = (items.select(F.col("item_id").alias("iid"), F.col("embedding").alias("iv"),
                       F.pmod(F.xxhash64("item_id"), F.lit(bi)).alias("ib"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))))
    digits = SCORE_DIGITS if cosine else None

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def block(qpd: pd.DataFrame, ipd: pd.DataFrame) -> pd.DataFrame:
        if qpd.empty or ipd.empty:
            return pd.DataFrame({"seed_id": [], "item_id": [], "similarity": []})
        qm = np.vstack([np.asarray(v, dtype=np.float64) for v in qpd["qv"]])
        im = np.vstack([np.asarray(v, dtype=np.float64) for v in ipd["iv"]])
        if cosine:
            qm, im = unit(qm), unit(im)
        sims = qm @ im.T
        if digits is not None:
            sims = np.round(sims, digits)
        qids = qpd["qid"].to_numpy(dtype=np.int64)
        iids = ipd["iid"].to_numpy(dtype=np.int64)
        if exclude_self:
            sims = np.where(qids[:, None] == iids[None, :], -np.inf, sims)
        kk = min(k, sims.shape[1])
        kth = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero((sims >= kth[:, None]) & np.isfinite(sims))
        return pd.DataFrame({"seed_id": qids[rows], "item_id": iids[cols], "similarity": sims[rows, cols]})

    part = q.groupBy("qb", "ib").cogroup(it.groupBy("qb", "ib")).applyInPandas(
        block, "seed_id long, item_id long, similarity double")
    return (top_k(part, ["seed_id"], "similarity", "item_id", k, digits=None)
            .select("seed_id", "item_id", "similarity", "rank"))


def _seed_matrix(seed_vecs: DataFrame):
    pdf = seed_vecs.select("seed_id", "embedding").toPandas()
    if pdf.empty:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    ids = pdf["seed_id"].to_numpy(dtype=np.int64)
    mat = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    mat = np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)
    return ids, mat


def embedding_topk_for_seeds(items: DataFrame, seeds: DataFrame, k: int,
                             exclude_self: bool = True, max_seeds: int = 100_000) -> DataFrame:
    """Top-k cosine neighbours of each seed among ``items(item_id, embedding)``.

    Output ``(seed_id, item_id, similarity, rank)``.  Items without a vector
    (null or empty) cannot be scored and are left out.  Seed vectors within
    ``max_seeds`` (checked on a materialised copy) are shipped to every task;
    a larger seed set takes the blocked cogroup form."""
    items = items.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    seed_vecs = (items.join(seeds.select("seed_id").distinct(), items.item_id == seeds.seed_id)
                 .select("seed_id", "embedding"))
    seed_vecs, small = checked_small(seed_vecs, max_seeds)
    if not small:
        return dense_topk_blocked(seed_vecs, items, k, cosine=True, exclude_self=exclude_self)
    ids, mat = _seed_matrix(seed_vecs)
    spark = items.sparkSession
    bc = spark.sparkContext.broadcast((ids, mat))
    schema = "seed_id long, item_id long, similarity double"

    def per_batch(batches):
        s_ids, s_mat = bc.value
        for pdf in batches:
            if pdf.empty or len(s_ids) == 0:
                continue
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            sims = np.round(x @ s_mat.T, SCORE_DIGITS)          # batch x seeds
            item_ids = pdf["item_id"].to_numpy(dtype=np.int64)
            if exclude_self:
                sims = np.where(item_ids[:, None] == s_ids[None, :], -np.inf, sims)
            kk = min(k, sims.shape[0])
            # k-th best per seed; keep everything at or above it (ties kept)
            kth = -np.partition(-sims, kk - 1, axis=0)[kk - 1]
            rows, cols = np.nonzero((sims >= kth[None, :]) & np.isfinite(sims))
            yield pd.DataFrame({"seed_id": s_ids[cols], "item_id": item_ids[rows],
                                "similarity": sims[rows, cols]})

    cand = items.select("item_id", "embedding").mapInPandas(per_batch, schema)
    return (top_k(cand, ["seed_id"], "similarity", "item_id", k, digits=None)
            .select("seed_id", "item_id", "similarity", "rank"))
