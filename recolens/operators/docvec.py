"""M4: paragraph vectors (distributed memory, negative sampling), trained in partitions.

A word is predicted from the mean of its document's vector and the vectors of the
words around it, against words drawn by frequency^0.75 (``NEGATIVE`` by weight, three
times as many drawn for each chunk of places).  A round sends the
two word tables to every partition, which goes over its documents ``sync_every`` times
and returns the changes of the words it has met; the changes of a word are averaged over
the partitions that met it.  Document vectors stay with their rows.

``infer`` gives a vector to any text with the word tables frozen, and is the
final step for the training documents as well, so equal texts have equal
vectors.  The word tables are bounded by ``max_words`` x ``size`` (the most frequent
words, ties by word); that is all that reaches the driver.  A document is one row.  Its
passes are cut into chunks of ``CHUNK`` words.

Null texts are empty; a text without a known word has the zero vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators.dense_index import lists_of as _lists
from recolens.operators.ids import dense_ids
from recolens.operators.tfidf import top_terms
from recolens.session import cut_lineage

# Fixed values of the reference's paragraph vectors.
SIZE = 128
WINDOW = 5
MIN_COUNT = 2
EPOCHS = 30
# Values of this trainer.
NEGATIVE = 5
RATE, LAST_RATE = 0.1, 0.0001
CHUNK = 32       # products this small stay on one thread
HELD = 50_000    # words of a document whose window sums are kept between passes
SEED = 42


@dataclass
class DocVecModel:
    words: DataFrame          # (word, wid)
    counts: np.ndarray        # of each wid
    inner: np.ndarray         # word vectors
    outer: np.ndarray         # vectors that predict
    size: int
    window: int
    epochs: int


def vocabulary(tokens: DataFrame, min_count: int, max_words: int) -> DataFrame:
    """(word, wid, tf): the ``max_words`` most frequent words of ``tokens`` (item_id, toks)."""
    stats = (tokens.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
             .where(F.col("tf") >= min_count))
    kept = cut_lineage(top_terms(stats, max_words))
    return cut_lineage(kept.join(dense_ids(kept, "term", "wid"), "term").select(F.col("term").alias("word"), "wid", "tf"))


def coded(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(item_id, wids): the known words of every text in order; a text may have none."""
    place = (tokens.withColumn("row", F.monotonically_increasing_id()))
    place = cut_lineage(place)
    known = (place.select("row", F.posexplode("toks").alias("at", "word")).join(F.broadcast(words.select("word", "wid")), "word")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "wid"))).alias("e")))
    return (place.join(known, "row", "left")
            .select("item_id", F.coalesce(F.transform("e", lambda x: x["wid"]), F.array().cast("array<int>")).alias("wids")))


def _noise(counts: np.ndarray) -> np.ndarray:
    weight = counts.astype(np.float64) ** 0.75
    return np.cumsum(weight / weight.sum())


@lru_cache(maxsize=64)
def _around(n: int, first: int, last: int, window: int) -> np.ndarray:
    """1 where a place of ``n`` (columns) is in the window of the places first..last (rows)."""
    gap = np.abs(np.arange(first, last)[:, None] - np.arange(n))
    return ((gap > 0) & (gap <= window)).astype(np.float32)


def _grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of ``at``, its sorting order and where each number begins in it."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], order, first


def _sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``at`` and the matrix of ones that adds up rows of equal ones."""
    known, which = np.unique(at, return_inverse=True)
    ones = np.zeros((len(known), len(at)), np.float32)
    ones[which, np.arange(len(at))] = 1
    return known, ones


def _chunks(wids: np.ndarray, window: int, learn_words: bool) -> list[tuple]:
    """What passes over a document share: places, windows and, to learn, equal words of each chunk."""
    n, out = len(wids), []
    for start in range(0, n, CHUNK):
        end = min(n, start + CHUNK)
        left, right = max(0, start - window), min(n, end + window)
        seen, target = wids[left:right], wids[start:end]
        band = _around(right - left, start - left, end - left, window)
        size = (band.sum(axis=1, keepdims=True) + 1)
        of_seen, of_target = (_sums(seen), _sums(target)) if learn_words else (None, None)
        if learn_words:
            of_seen = of_seen[0], of_seen[1] @ band.T
        out.append((seen, target, band, 1 / size, of_seen, of_target))
    return out


@np.errstate(over="ignore")                 # odds beyond any float are as good as certain
def passes(wids, vec, inner, outer, noise, rates, rngs, window, learn_words):
    """Passes over a document, one for each rate and generator: ``vec`` and, if ``learn_words``,
    both tables change in place.

    The places of a chunk share their drawn words, so most of the work is products of
    small matrices.  While words are frozen, the sums of windows are the same in every pass
    and are kept, for ``HELD`` words at most."""
    chunks = _chunks(wids, window, learn_words)
    held = None
    if not learn_words and len(wids) <= HELD:
        held = [(band @ inner[seen], outer[target]) for seen, target, band, *_ in chunks]
    for rate, rng in zip(rates, rngs):
        draws = np.searchsorted(noise, rng.random((len(chunks), NEGATIVE * 3))).clip(max=len(noise) - 1)
        for c, (seen, target, band, share, of_seen, of_target) in enumerate(chunks):
            around, right_out = held[c] if held else (band @ inner[seen], outer[target])
            drawn = draws[c]
            hidden = (vec + around) * share
            wrong_out = outer[drawn]
            lift = np.float32(rate) / (1 + np.exp(np.einsum("ij,ij->i", hidden, right_out)[:, None]))
            drop = np.float32(rate / 3) / (1 + np.exp(-(hidden @ wrong_out.T))) * (drawn != target[:, None])
            if learn_words:
                back = (lift * right_out - drop @ wrong_out) * share
                outer[of_target[0]] += of_target[1] @ (lift * hidden)
                less = drop.T @ hidden
                if len(set(drawn.tolist())) == len(drawn):
                    outer[drawn] -= less
                else:
                    known, ones = _sums(drawn)
                    outer[known] -= ones @ less
                inner[of_seen[0]] += of_seen[1] @ back
                vec += back.sum(axis=0)
            else:
                # the sum over places of (lift x right - drop x wrong) / size, without a row a place
                vec += ((lift * share).T @ right_out)[0] - (drop * share).sum(axis=0) @ wrong_out


def _rng(seed: int, wids: np.ndarray) -> np.random.Generator:
    return np.random.default_rng([seed, len(wids), int(wids.astype(np.int64).sum()) & 0x7FFFFFFF])


def _round(state: DataFrame, model: DocVecModel, first_epoch: int, last_epoch: int) -> DataFrame:
    """Rows of documents (item_id, wids, vec) and of changed words (wid, inner, outer)."""
    shared = state.sparkSession.sparkContext.broadcast((model.inner, model.outer, _noise(model.counts)))
    size, window, epochs = model.size, model.window, model.epochs
    schema = pa.schema([("item_id", pa.int64()), ("wids", pa.list_(pa.int32())), ("vec", pa.list_(pa.float32())),
                        ("wid", pa.int32()), ("inner", pa.list_(pa.float32())), ("outer", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before_in, before_out, noise = shared.value
        inner, outer = before_in.copy(), before_out.copy()
        for batch in batches:
            vecs = []
            for wids, vec in zip(batch.column(1), batch.column(2)):
                wids = wids.values.to_numpy()
                vec = np.zeros(size, np.float32) if not vec.is_valid else vec.values.to_numpy().copy()
                rates = [RATE + (LAST_RATE - RATE) * epoch / epochs for epoch in range(first_epoch, last_epoch)]
                if len(wids):
                    passes(wids, vec, inner, outer, noise, rates,
                           (_rng(SEED + epoch, wids) for epoch in range(first_epoch, last_epoch)), window, True)
                vecs.append(vec)
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, schema.field("inner").type)
            yield pa.record_batch([batch.column(0), batch.column(1).cast(schema.field("wids").type),
                                   pa.array(vecs, schema.field("vec").type), none[0], none[1], none[1]], schema=schema)
        met = np.nonzero((inner != before_in).any(axis=1) | (outer != before_out).any(axis=1))[0]
        for at in range(0, len(met), 4096):
            w = met[at:at + 4096]
            yield pa.record_batch([pa.nulls(len(w), pa.int64()), pa.nulls(len(w), schema.field("wids").type),
                                   pa.nulls(len(w), schema.field("vec").type), pa.array(w.astype(np.int32)),
                                   _lists(inner[w] - before_in[w]),
                                   _lists(outer[w] - before_out[w])], schema=schema)

    return cut_lineage(state.select("item_id", "wids", "vec").mapInArrow(
        run, "item_id long, wids array<int>, vec array<float>, wid int, inner array<float>, outer array<float>"))


def _averaged(changes: DataFrame, model: DocVecModel) -> DocVecModel:
    """The word tables after the mean change of every word; one row a word and partition is summed."""
    def run(t: pa.Table) -> pa.Table:
        wid = t.column("wid").to_numpy()
        known, order, first = _grouped(wid)
        n = np.diff(np.append(first, len(wid)))
        out = {"wid": pa.array(known)}
        for c in ("inner", "outer"):
            total = np.add.reduceat(t.column(c).combine_chunks().flatten().to_numpy().reshape(len(wid), -1)[order].astype(np.float64), first, axis=0)
            out[c] = _lists((total / n[:, None]).astype(np.float32))
        return pa.table(out)

    mean = (changes.where("wid is not null").select("wid", "inner", "outer", F.floor(F.col("wid") / 256).alias("some"))
            .groupBy("some").applyInArrow(run, "wid int, inner array<float>, outer array<float>"))
    inner, outer = model.inner.copy(), model.outer.copy()
    table = mean.toArrow()                      # at most max_words rows
    wid = table.column("wid").to_numpy()
    for c, into in (("inner", inner), ("outer", outer)):
        if len(wid):
            into[wid] += table.column(c).combine_chunks().flatten().to_numpy().reshape(len(wid), -1)
    return DocVecModel(model.words, model.counts, inner, outer, model.size, model.window, model.epochs)


def fit(tokens: DataFrame, size: int = SIZE, window: int = WINDOW, min_count: int = MIN_COUNT, epochs: int = EPOCHS,
        sync_every: int = 3, max_words: int = 50_000, trainers: int | None = None) -> DocVecModel:
    """Word tables from ``tokens`` (item_id, toks).  A partition is one trainer: one for
    each core unless ``trainers`` says otherwise; fewer learn more from a round."""
    vocab = vocabulary(tokens, min_count, max_words)
    counts = np.array([r.tf for r in vocab.orderBy("wid").select("tf").collect()], dtype=np.int64)   # <= max_words
    rng = np.random.default_rng(SEED)
    inner = ((rng.random((len(counts), size)) - 0.5) / size).astype(np.float32)
    model = DocVecModel(vocab.select("word", "wid"), counts, inner, np.zeros((len(counts), size), np.float32),
                        size, window, epochs)
    if not len(counts):
        return model
    trainers = trainers or tokens.sparkSession.sparkContext.defaultParallelism
    state = cut_lineage(coded(tokens, model.words).repartition(trainers)
                        .withColumn("vec", F.lit(None).cast("array<float>")))
    for epoch in range(0, epochs, sync_every):
        out = _round(state, model, epoch, min(epochs, epoch + sync_every))
        model = _averaged(out, model)
        state = out.where("wid is null")
    return model


def infer(tokens: DataFrame, model: DocVecModel, epochs: int | None = None) -> DataFrame:
    """(item_id, embedding): vectors of texts, seen or not, with the words frozen."""
    epochs, size, window = epochs or model.epochs, model.size, model.window
    shared = tokens.sparkSession.sparkContext.broadcast(
        (model.inner, model.outer, _noise(model.counts) if len(model.counts) else None))
    schema = pa.schema([("item_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer, noise = shared.value
        for batch in batches:
            vecs = []
            for wids in batch.column(1):
                wids, vec = wids.values.to_numpy(), np.zeros(size, np.float32)
                if len(wids):
                    rates = [RATE + (LAST_RATE - RATE) * epoch / epochs for epoch in range(epochs)]
                    passes(wids, vec, inner, outer, noise, rates, (_rng(epoch, wids) for epoch in range(epochs)), window, False)
                vecs.append(vec)
            yield pa.record_batch([batch.column(0), pa.array(vecs, schema.field("embedding").type)], schema=schema)

    rows = coded(tokens, model.words).select(F.col("item_id").cast("long"), "wids")
    return rows.repartition(max(tokens.sparkSession.sparkContext.defaultParallelism, tokens.rdd.getNumPartitions())).mapInArrow(
        run, "item_id long, embedding array<float>")
