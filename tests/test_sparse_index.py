"""Blocks with bounds against plain all-pairs cosines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recolens.operators import blocks, sparse_index, tfidf


def corpus(rng, n):
    common = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(n):
        topic = rng.randrange(6)
        words = [rng.choice(common) for _ in range(rng.randrange(3, 25))]
        words += [f"t{topic}x{rng.randrange(15)}" for _ in range(rng.randrange(0, 12))]
        docs.append(" ".join(words))
    docs += [docs[0]] * 7 + [docs[1] + " w3"] * 4 + ["", "only once"]
    return list(enumerate(docs))


def cosines(weights):
    vectors = {}
    for r in weights.collect():
        vectors.setdefault(r.item_id, {})[r.term] = r.w
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vectors.items()}
    return {(a, b): round(sum(w * vectors[b].get(t, 0) for t, w in va.items()) / (norm[a] * norm[b]), 6)
            for a, va in vectors.items() for b in vectors}


def best(pairs, seed, k, own):
    found = sorted((-s, b) for (a, b), s in pairs.items() if a == seed and s > 0 and (own or b != seed))
    return [(b, -s) for s, b in found[:k]]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(corpus(random.Random(5), 90), "item_id long, text string")
    seg = tfidf.single_segment(docs, "item_id", "text")
    _, model, w = tfidf.fit_corpus(seg, docs.count(), max_features=300, multi_segment=False)
    w = w.cache()
    return model, w, cosines(w)


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.seed_id, r["rank"])):
        out.setdefault(r.seed_id, []).append((r.item_id, r.similarity))
    return out


@pytest.mark.parametrize("block_items,parts,k", [(1, 4096, 3), (8, 5, 3), (8, 4096, 20), (1024, 4096, 5)])
def test_all_items_topk_is_exact(fitted, block_items, parts, k):
    model, w, pairs = fitted
    got = listed(sparse_index.all_items_topk(w, model, k, block_items, parts))
    seeds = {a for a, _ in pairs}
    for s in seeds:
        want = best(pairs, s, k, own=False)
        assert [i for i, _ in got.get(s, [])] == [i for i, _ in want], s
        assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got.get(s, []), want))


def test_needed_terms_leave_out_what_cannot_reach_the_floor(fitted):
    model, w, pairs = fitted
    terms = sparse_index.term_numbers(model)
    vectors = sparse_index.unit_vectors(w, terms)
    index = sparse_index.build(vectors, terms, terms.count(), 8)
    asked = vectors.withColumnRenamed("item_id", "seed_id").withColumn("floor", F.lit(0.9))
    kept = {r.seed_id: (set(r.tids), r.rest) for r in sparse_index.needed_terms(asked, index).collect()}
    whole = {r.seed_id: set(r.tids) for r in asked.collect()}
    assert sum(len(whole[s]) - len(kept[s][0]) for s in kept) > 0 and all(rest < 0.9 for _, rest in kept.values())
    for (a, b), s in pairs.items():
        if s >= 0.9 + 1e-6:
            assert kept[a][0] & whole[b], "a pair that reaches the floor shares a needed term"
    none = sparse_index.needed_terms(asked.withColumn("floor", F.lit(None).cast("double")), index).collect()
    assert all(set(r.tids) == whole[r.seed_id] and r.rest == 0 for r in none)


def test_search_is_exact_and_skips_blocks(spark, fitted):
    model, w, pairs = fitted
    terms = sparse_index.term_numbers(model)
    index = sparse_index.build(sparse_index.unit_vectors(w, terms), terms, terms.count(), 4)
    queries = w.where("item_id % 7 = 0").withColumnRenamed("item_id", "seed_id")
    found = sparse_index.search(queries, index, 4)
    got = listed(found.top)
    for s in {r.seed_id for r in queries.select("seed_id").distinct().collect()}:
        want = best(pairs, s, 4, own=True)
        assert [i for i, _ in got[s]] == [i for i, _ in want]
    assert found.routes.count() < found.bounds.count()
    nothing = spark.createDataFrame([], "seed_id long, term string, w double")
    assert sparse_index.search(nothing, index, 4).top.count() == 0


def test_equal_vectors_are_one_class(spark):
    members = spark.createDataFrame([(i, 0) for i in range(40)] + [(50, 50), (51, 50), (60, 60)], "item_id long, rep long")
    pairs = spark.createDataFrame([(0, 50, 0.5), (50, 0, 0.5), (50, 60, 0.5), (60, 50, 0.5)],
                                  "seed_id long, item_id long, similarity double")
    got = listed(blocks.members_topk(members, pairs, 3))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[2] == [(0, 1.0), (1, 1.0), (3, 1.0)]
    assert got[39] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert got[50] == [(51, 1.0), (0, 0.5), (1, 0.5)] and got[60] == [(50, 0.5), (51, 0.5)]


def test_waves_of_queries_leave_no_routes_and_spent_terms_go(spark, fitted, monkeypatch, tmp_path):
    """A wave for every group: lists stay exact, the (query, block) rows of a wave are gone after
    it, and the folder that the weights were read from with them."""
    model, w, pairs = fitted
    made = []
    monkeypatch.setattr(sparse_index, "WAVE_GROUPS", 1)
    monkeypatch.setattr(sparse_index, "scratch_folder", lambda s, name: (made.append(f"{tmp_path}/{name}-{len(made)}"), made[-1])[1])
    w.write.parquet(f"{tmp_path}/terms")
    got = listed(sparse_index.all_items_topk(spark.read.parquet(f"{tmp_path}/terms"), model, 4, 8, spent=f"{tmp_path}/terms"))
    for s in {a for a, _ in pairs}:
        assert got.get(s, []) == best(pairs, s, 4, own=False)
    assert sum("routes" in x for x in made) > 1 and not list(tmp_path.iterdir())
