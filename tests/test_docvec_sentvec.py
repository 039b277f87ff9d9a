"""Paragraph vectors and sentence vectors: neighbours, inference, NumPy's SVD."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recolens.operators import docvec, sentvec


def topics(rng, n):
    docs = []
    for i in range(n):
        topic = i % 5
        docs.append([f"t{topic}w{rng.randrange(25)}" if rng.random() < 0.7 else f"c{rng.randrange(20)}" for _ in range(120)])
    return docs


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(3)
    docs = topics(rng, 150)
    for i in range(10):                    # near copies of the first ten
        copy = list(docs[i])
        copy[7], copy[23] = "c1", "c2"
        docs.append(copy)
    docs += [[], ["unheard"], docs[0]]
    tokens = spark.createDataFrame(list(enumerate(docs)), "item_id long, toks array<string>").repartition(4)
    model = docvec.fit(tokens, size=24, epochs=30, sync_every=3, trainers=2)
    return docs, tokens, model


def cosine(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return u @ u.T


def test_near_copies_are_nearest(trained):
    docs, tokens, model = trained
    rows = {r.item_id: np.array(r.embedding) for r in docvec.infer(tokens, model).collect()}
    assert len(rows) == len(docs) and not rows[160].any() and not rows[161].any()
    assert np.array_equal(rows[0], rows[162]), "equal texts, equal vectors"
    sims = cosine(np.array([rows[i] for i in range(160)]))
    np.fill_diagonal(sims, -1)
    assert sum(150 + i in np.argsort(-sims[i])[:2] for i in range(10)) >= 8
    near = np.argsort(-sims[:150, :150], axis=1)[:, :5]
    assert np.mean([[j % 5 == i % 5 for j in near[i]] for i in range(150)]) > 0.75


def test_unseen_texts_are_inferred(spark, trained):
    docs, tokens, model = trained
    new = topics(random.Random(77), 20)
    unseen = spark.createDataFrame(list(enumerate(new)), "item_id long, toks array<string>")
    vecs = {r.item_id: np.array(r.embedding) for r in docvec.infer(unseen, model).collect()}
    old = {r.item_id: np.array(r.embedding) for r in docvec.infer(tokens, model).collect()}
    m = np.array([old[i] for i in range(150)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = [int((m @ vecs[i]).argmax()) % 5 == i % 5 for i in range(20)]
    assert np.mean(best) >= 0.75
    empty = tokens.where("item_id < 0")
    assert docvec.infer(empty, docvec.fit(empty, size=8, epochs=1)).count() == 0


def test_sentence_vectors_match_svd(spark):
    rng = np.random.default_rng(6)
    words = {f"w{i}": rng.normal(size=10) + 0.8 for i in range(40)}
    texts = [[f"w{min(39, int(rng.exponential(9)))}" for _ in range(int(rng.integers(1, 30)))] for _ in range(60)] + [[], ["no"]]
    tokens = spark.createDataFrame(list(enumerate(texts)), "item_id long, toks array<string>").repartition(3)
    table = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in words.items()], "word string, v array<double>")
    vectors = table.select("word", array_to_vector("v").alias("vector"))
    got = {r.item_id: np.array(r.embedding) for r in sentvec.sentence_vectors(tokens, vectors, 10).collect()}
    n = sum(map(len, texts))
    share = {w: sum(t.count(w) for t in texts) / n for w in words}
    plain = np.zeros((len(texts), 10))
    for i, t in enumerate(texts):
        known = [w for w in t if w in words]
        for w in known:
            plain[i] += words[w] * 1e-3 / (1e-3 + share[w]) / len(known)
    u = np.linalg.svd(plain, full_matrices=False)[2][0]
    want = plain - np.outer(plain @ u, u)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-8)
    assert not got[60].any() and not got[61].any()
    flat = spark.createDataFrame([(1, [0.0, 0.0])], "item_id long, embedding array<double>")
    assert not sentvec.common_direction(flat, 2).any()
    assert sentvec.without_direction(flat.where(F.lit(False)), np.zeros(2)).count() == 0


def test_window_sums_are_taken_once_while_words_are_frozen(monkeypatch):
    """Thirty passes of inference added up the same windows thirty times."""
    rng = np.random.default_rng(5)
    inner, outer = (rng.normal(size=(50, 8)).astype(np.float32) for _ in range(2))
    wids, noise = rng.integers(0, 50, 100), np.cumsum(np.full(50, 0.02))

    class Counted(np.ndarray):
        taken = 0

        def __getitem__(self, at):
            Counted.taken += 1
            return np.asarray(self)[at]

    def run(held):
        monkeypatch.setattr(docvec, "HELD", held)
        Counted.taken, vec = 0, np.zeros(8, np.float32)
        docvec.passes(wids, vec, inner.view(Counted), outer, noise, [0.1] * 30, [np.random.default_rng(i) for i in range(30)], 5, False)
        return vec, Counted.taken

    (once, few), (again, many) = run(1000), run(0)
    assert np.allclose(once, again, atol=1e-6) and few == 4 and many == 120
