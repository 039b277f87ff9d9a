"""TF-IDF and cosine top-k against a plain-Python implementation of the
vectoriser semantics, and dense top-k against numpy brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from recolens.operators import similarity, tfidf

DOCS = {
    1: ["red bolt small", "great bolt"],
    2: ["red widget", "small red widget red"],
    3: ["blue gear"],
    4: ["blue gear hot", ""],
    5: ["", "x y z"],
    6: ["great small bolt red"],
}


def py_terms(segs):
    toks = []
    for s in segs:
        toks += re.findall(r"\w{2,}", s)
    return Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])


def py_model(docs, min_df=2, max_features=None):
    tf = {d: py_terms(s) for d, s in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    ctf = Counter()
    for c in tf.values():
        ctf.update(c)
    vocab = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))
    if max_features:
        vocab = vocab[:max_features]
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    w = {}
    for d, c in tf.items():
        v = {t: c[t] * idf[t] for t in c if t in idf}
        nrm = math.sqrt(sum(x * x for x in v.values()))
        w[d] = {t: x / nrm for t, x in v.items()} if nrm else {}
    return idf, w


def _segments(spark):
    rows = [(d, i, t) for d, segs in DOCS.items() for i, t in enumerate(segs)]
    return spark.createDataFrame(rows, "item_id long, seg_order long, text string")


@pytest.mark.parametrize("max_features", [None, 5])
def test_tfidf_weights_match(spark, max_features):
    counts, model, _ = tfidf.fit_corpus(_segments(spark), len(DOCS), min_df=2,
                                        max_features=max_features)
    idf, w = py_model(DOCS, 2, max_features)
    got_vocab = {r["term"]: r["idf"] for r in model.vocab.collect()}
    assert set(got_vocab) == set(idf)
    for t in idf:
        assert got_vocab[t] == pytest.approx(idf[t])
    got = {}
    for r in tfidf.transform(counts, model).collect():
        got.setdefault(r["item_id"], {})[r["term"]] = r["weight"]
    for d in DOCS:
        assert got.get(d, {}) == pytest.approx(w[d])


def test_cross_segment_bigram(spark):
    counts = tfidf.segment_terms(_segments(spark), materialize=False)
    terms = {(r["item_id"], r["term"]) for r in counts.collect()}
    assert (1, "small great") in terms       # boundary of segments 0 and 1
    assert (4, "hot ") not in terms and (5, " x") not in terms


def test_cosine_topk_matches_brute_force(spark):
    _, _, w_raw = tfidf.fit_corpus(_segments(spark), len(DOCS), min_df=2, max_features=None)
    _, w = py_model(DOCS)
    seeds = spark.createDataFrame([(1,), (3,), (5,)], "seed_id long")
    got = similarity.cosine_topk_for_seeds(w_raw, seeds, 3).collect()
    for s in (1, 3, 5):
        sims = [(o, round(sum(w[s].get(t, 0) * x for t, x in w[o].items()), 6)) for o in DOCS if o != s]
        sims = sorted([x for x in sims if x[1] > 0], key=lambda x: (-x[1], x[0]))[:3]
        g = sorted((r["rank"], r["item_id"], r["similarity"]) for r in got if r["seed_id"] == s)
        assert [(i, v) for _, i, v in g] == [(i, pytest.approx(v)) for i, v in sims]


def test_embedding_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    x[7] = x[3]                       # exact tie
    items = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)],
                                  "item_id long, embedding array<float>").repartition(4)
    seeds = spark.createDataFrame([(3,), (10,), (49,)], "seed_id long")
    got = similarity.embedding_topk_for_seeds(items, seeds, 5).collect()
    xn = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for s in (3, 10, 49):
        sims = np.round(xn @ xn[s], 6)
        order = sorted((i for i in range(50) if i != s), key=lambda i: (-sims[i], i))[:5]
        g = [r["item_id"] for r in sorted((r for r in got if r["seed_id"] == s), key=lambda r: r["rank"])]
        assert g == order


def test_wordvec_item_vectors_equal_transform(spark):
    from pyspark.ml.functions import vector_to_array

    from recolens.operators import wordvec
    rows = [(1, 0, "red bolt small red"), (1, 1, "great bolt zzz"), (2, 0, "red widget"),
            (2, 1, "small red widget red"), (3, 0, "blue gear"), (3, 1, "")]
    seg = spark.createDataFrame(rows, "item_id long, seg_order long, text string")
    toks = wordvec.segment_tokens(seg)
    model = wordvec.fit(toks, vector_size=8, min_count=2, num_partitions=1)
    got = {r["item_id"]: r["embedding"] for r in wordvec.item_vectors(model, toks).collect()}
    docs = {}
    for i, o, t in sorted(rows):
        docs.setdefault(i, []).extend(t.split())
    ref = model.transform(spark.createDataFrame([(i, w) for i, w in docs.items()], "item_id long, toks array<string>"))
    want = {r["item_id"]: r["v"] for r in ref.select("item_id", vector_to_array("__v").alias("v")).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)


def test_cosine_symmetric_and_bounded(spark):
    _, _, w = tfidf.fit_corpus(_segments(spark), len(DOCS), min_df=1, max_features=None)
    seeds = spark.createDataFrame([(d,) for d in DOCS], "seed_id long")
    sims = {(r["seed_id"], r["item_id"]): r["similarity"]
            for r in similarity.cosine_topk_for_seeds(w, seeds, 100).collect()}
    assert sims
    for (a, b), v in sims.items():
        assert a != b and 0 < v <= 1.0 + 1e-9
        assert sims.get((b, a)) == pytest.approx(v)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 5))
    items = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(12)],
                                  "item_id long, embedding array<double>")
    e = {(r["seed_id"], r["item_id"]): r["similarity"] for r in similarity.embedding_topk_for_seeds(
        items, spark.createDataFrame([(i,) for i in range(12)], "seed_id long"), 11).collect()}
    assert len(e) == 12 * 11
    for (a, b), v in e.items():
        assert -1 - 1e-9 <= v <= 1 + 1e-9 and e[(b, a)] == pytest.approx(v)


def test_boundary_bigrams_two_level_equals_sequential(spark):
    import random
    from collections import Counter
    rnd = random.Random(17)
    words = ["aa", "bb", "cc", "dd", ""]
    rows = []
    for item in range(4):
        orders = rnd.sample(range(3000), 300 if item == 0 else 25)   # item 0 is "hot"
        rows += [(item, o, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))).strip())
                 for o in orders]
    seg = spark.createDataFrame(rows, "item_id long, seg_order long, text string")
    toks = tfidf.tokenize_segments(seg)
    got = Counter((r["item_id"], r["term"]) for r in tfidf.boundary_bigrams(toks, chunk=7).collect())
    want = Counter()
    for item in range(4):
        segs = [t.split() for _, _, t in sorted(r for r in rows if r[0] == item and r[2].split())
                if True]
        segs = [s for s in (x for x in segs) if s]
        for a, b in zip(segs, segs[1:]):
            want[(item, f"{a[-1]} {b[0]}")] += 1
    assert got == want


@pytest.mark.parametrize("tie_bound", [200_000, 3])     # small top-n / distributed tie ranking
@pytest.mark.parametrize("n", [1, 4, 7, 12, 50])
def test_top_terms_exact(spark, n, tie_bound):
    import random
    rnd = random.Random(n)
    rows = [(f"t{i:02d}", rnd.choice([1, 2, 2, 3, 3, 3, 5])) for i in range(30)]
    stats = spark.createDataFrame(rows, "term string, tf long").repartition(4)
    got = sorted(r["term"] for r in tfidf.top_terms(stats, n, tie_bound=tie_bound).collect())
    want = sorted(t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
    assert got == want


def test_embedding_topk_skips_missing_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.1]), (4, [])],
                                  "item_id long, embedding array<double>")
    seeds = spark.createDataFrame([(1,), (2,)], "seed_id long")
    got = [(r.seed_id, r.item_id) for r in similarity.embedding_topk_for_seeds(items, seeds, 3).collect()]
    assert got == [(1, 3)]


def test_embedding_blocked_fallback_equals_broadcast(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 6))
    x[11] = x[5]
    items = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)],
                                  "item_id long, embedding array<double>")
    seeds = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "seed_id long")
    a = sorted(tuple(r) for r in similarity.embedding_topk_for_seeds(items, seeds, 4).collect())
    b = sorted(tuple(r) for r in similarity.embedding_topk_for_seeds(items, seeds, 4, max_seeds=5).collect())
    c = sorted(tuple(r) for r in similarity.dense_topk_blocked(
        items.join(seeds, items.item_id == seeds.seed_id).select("seed_id", "embedding"),
        items, 4, exclude_self=True, block_rows=7).collect())
    assert a == b == c and len(a) == 20 * 4


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_seed_scores_make_no_pair_rows(spark, monkeypatch, cells):
    """Every item shares a term with every seed: ties by item id, and no join of seeds with items."""
    monkeypatch.setattr(similarity, "SCORE_CELLS", cells)
    rows = [(i, t, w) for i in range(90) for t, w in [("all", 1.0), (f"some{i % 3}", 2.0)]] + [(90, "alone", 1.0), (None, "all", 1.0)]
    weights = spark.createDataFrame(rows, "item_id long, term string, w double").repartition(5)
    seeds = spark.createDataFrame([(i,) for i in (0, 1, 2, 90)], "seed_id long")
    top = similarity.cosine_topk_for_seeds(weights, seeds, 31)
    got = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.seed_id, []).append((r.item_id, r.similarity))
    for s in (0, 1, 2):
        like = [i for i in range(90) if i % 3 == s and i != s]
        assert got[s] == [(i, 1.0) for i in like] + [(i, 0.2) for i in range(90) if i % 3 != s][:2]
    assert 90 not in got
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "w_q" not in plan
