"""M5 without a pretrained encoder: sentence vectors from weighted word vectors.

A text's vector is the mean of its words' vectors, each weighted by a / (a + p(word))
with p the word's share of the corpus, so frequent words count little.  The direction
that most vectors share is then removed.  It is found by power iteration on the sum of
v v', added up inside tasks in one pass, one matrix a task; vectors are never collected.

Texts without a known word have the zero vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.operators import wordvec
from recolens.operators.dense_index import lists_of, rows_of
from recolens.session import cut_lineage, written

SMOOTH = 1.0e-3
STEPS, CLOSE = 100, 1.0e-10


def weighted_means(tokens: DataFrame, word_vectors: DataFrame, size: int, smooth: float = SMOOTH) -> DataFrame:
    """(item_id, embedding array<double>) of ``tokens`` (item_id, toks) and (word, vector)."""
    counts = tokens.select(F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    weight = F.lit(smooth) / (F.lit(smooth) + F.col("n") / F.lit(total))
    weighted = word_vectors.join(counts, "word").select(
        "word", F.transform(vector_to_array("vector"), lambda x: x * weight).alias("vector"))
    bags = tokens.select("item_id", F.col("toks").alias("words"), F.lit(None).cast("array<double>").alias("tf"))
    return (wordvec.weighted_sums(bags, weighted, size)
            .select("item_id", F.transform("sums", lambda x: x / F.greatest("n_known", F.lit(1.0))).alias("embedding")))


def common_direction(vectors: DataFrame, size: int) -> np.ndarray:
    """The first right singular vector of all ``embedding`` rows, by power iteration on
    their ``size`` x ``size`` matrix of products, which is summed in one pass."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                m = rows_of(b.column(0))
                total += m.T @ m
        yield pa.record_batch([lists_of(total.reshape(1, -1))], names=["part"])

    parts = vectors.select("embedding").mapInArrow(products, "part array<double>")
    whole = np.zeros(size * size)
    for r in parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        whole[r.at] = r.x
    whole = whole.reshape(size, size)
    u = np.ones(size) / np.sqrt(size)
    for _ in range(STEPS):
        new = whole @ u
        length = np.linalg.norm(new)
        if length == 0:
            return np.zeros(size)
        new /= length
        if np.abs(new - u).max() < CLOSE:
            return new
        u = new
    return u


def without_direction(vectors: DataFrame, u: np.ndarray) -> DataFrame:
    """(item_id, embedding) with the projection on ``u`` taken away."""
    way = F.array(*(F.lit(float(x)) for x in u))
    dot = F.aggregate(F.zip_with("embedding", way, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (vectors.select("item_id", "embedding", dot.alias("dot"))
            .select("item_id", F.zip_with("embedding", F.transform(way, lambda y: y * F.col("dot")), lambda x, y: x - y)
                    .alias("embedding")))


def sentence_vectors(tokens: DataFrame, word_vectors: DataFrame, size: int, smooth: float = SMOOTH) -> DataFrame:
    """(item_id, embedding array<double>) for every row of ``tokens`` (item_id, toks)."""
    means = cut_lineage(weighted_means(tokens, word_vectors, size, smooth))
    return without_direction(means, common_direction(means, size))
