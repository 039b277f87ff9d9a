"""Word2Vec without a table on the driver: codes, training, one row a text."""

import random

import numpy as np
from pyspark.sql import functions as F

from recolens.operators import wordvec


def sentences(rng, n):
    return [[f"t{i % 4}w{rng.randrange(12)}" if rng.random() < 0.8 else f"c{rng.randrange(9)}" for _ in range(40)] for i in range(n)]


def test_codes_are_prefix_free_and_short(spark):
    rng = random.Random(4)
    rows = [[f"w{min(300, int(rng.expovariate(0.02)))}" for _ in range(50)] for _ in range(80)] + [["lone"], [], [None, None]]
    frame = spark.createDataFrame([(r,) for r in rows], "toks array<string>")
    codes = {r.word: format(r.code, f"0{r.bits}b") for r in wordvec.coded_words(frame, 2).collect()}
    counts = {}
    for r in rows:
        for w in filter(None, r):
            counts[w] = counts.get(w, 0) + 1
    assert set(codes) == {w for w, n in counts.items() if n >= 2}
    ordered = sorted(codes.values())
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))
    share = {w: counts[w] / sum(counts[v] for v in codes) for w in codes}
    best = -sum(p * np.log2(p) for p in share.values())
    assert sum(share[w] * len(c) for w, c in codes.items()) <= best + 2
    one = spark.createDataFrame([(["a", "a"],)], "toks array<string>")
    assert [(r.code, r.bits) for r in wordvec.coded_words(one, 2).collect()] == [(0, 1)]


def test_training_keeps_words_off_the_driver(spark, monkeypatch):
    """MLlib's fit broadcast and collected whole word tables; no ml estimator is left."""
    assert not hasattr(wordvec, "Word2Vec")
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(random.Random(5), 400))], "item_id long, toks array<string>")
    for parts, iterations in ((1, 6), (3, 6)):
        model = wordvec.fit(frame, vector_size=16, num_partitions=parts, max_iter=iterations)
        v = {r.word: np.array(r.vector) for r in model.vectors.collect()}
        words = [w for w in v if w[0] == "t"]
        m = np.array([v[w] / np.linalg.norm(v[w]) for w in words])
        sims = m @ m.T
        np.fill_diagonal(sims, -2)
        same = [words[int(s.argmax())][1] == w[1] for w, s in zip(words, sims)]
        assert len(words) == 48 and np.mean(same) > 0.8, (parts, np.mean(same))
    again = {r.word: np.array(r.vector) for r in wordvec.fit(frame.repartition(1), vector_size=16, num_partitions=1).vectors.collect()}
    assert set(again) == set(v)


def test_frequent_words_do_not_run_away():
    """A chunk holds the same few words many times; plain sums of their steps overflowed."""
    rng = np.random.default_rng(7)
    way, turns = wordvec.paths(np.array([0, 2, 6, 7]), np.array([1, 2, 3, 3]))
    way = np.where(way >= 0, np.searchsorted(np.unique(way[way >= 0]), way), -1)
    words, nodes = rng.normal(size=(4, 8)).astype(np.float32) * 9, rng.normal(size=(3, 8)).astype(np.float32) * 9
    for _ in range(200):
        wids = rng.integers(0, 4, 64)
        wordvec.train_row(wids, words, nodes, way, turns, 5 - rng.integers(0, 5, 64), 0.025)
    assert np.isfinite(words).all() and np.abs(words).max() < 100 and np.abs(nodes).max() < 100


def test_row_means_keep_rows_and_count_unknown_words(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -2.0])], "word string, vector array<float>")
    model = wordvec.WordVectors(vectors, 2)
    rows = [(1, ["a", "b", "zz", "a"]), (1, ["b"]), (None, []), (2, None), (3, ["zz"])]
    frame = spark.createDataFrame(rows, "item_id long, toks array<string>")
    got = sorted((r.item_id or -1, tuple(r.embedding)) for r in wordvec.row_means(model, frame).collect())
    assert got == [(-1, (0.0, 0.0)), (1, (1.25, 0.5)), (1, (3.0, -2.0)), (2, (0.0, 0.0)), (3, (0.0, 0.0))]
    assert model.transform(frame.withColumn("x", F.lit(1))).count() == 5
