"""Co-reviewer Jaccard against brute force, incl. a hot user holding a third of
all rows and the salted (non-broadcast) path."""

import random

import pytest

from recolens.operators import overlap


def _pairs(n_users=60, n_items=40, n_rows=400, hot_share=1 / 3, seed=7):
    rnd = random.Random(seed)
    rows = set()
    hot = 0
    for i in range(int(n_rows * hot_share)):                  # hot user 0
        rows.add((hot, rnd.randrange(n_items)))
    while len(rows) < n_rows:
        rows.add((rnd.randrange(1, n_users), rnd.randrange(n_items)))
    # null keys and duplicates must be ignored
    return sorted(rows) + [(None, 3), (5, None)] + sorted(rows)[:10]


def _brute(rows, seeds, topn=1000):
    by_item = {}
    for u, i in rows:
        if u is None or i is None:
            continue
        by_item.setdefault(i, set()).add(u)
    out = {}
    for s in seeds:
        us = by_item.get(s, set())
        res = []
        for o, uo in by_item.items():
            if o == s:
                continue
            inter = len(us & uo)
            if inter:
                res.append((o, inter / len(us | uo), inter))
        res.sort(key=lambda x: (-x[1], x[0]))
        out[s] = res[:topn]
    return by_item, out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long")


@pytest.mark.parametrize("max_rows", [2_000_000, 5])   # broadcast path, salted path
def test_jaccard_matches_brute_force(spark, max_rows):
    rows = _pairs()
    pairs = overlap.distinct_pairs(_frame(spark, rows))
    seeds = spark.createDataFrame([(s,) for s in (0, 3, 7, 39, 999)], "seed_id long")
    got = overlap.jaccard_topk(pairs, seeds, topn=15, max_broadcast_rows=max_rows).collect()
    _, exp = _brute(rows, [0, 3, 7, 39, 999], topn=15)
    by_seed = {}
    for r in got:
        by_seed.setdefault(r["seed_id"], []).append((r["rel_rank"], r["item_id"], r["jaccard"], r["inter"]))
    for s, lst in exp.items():
        g = sorted(by_seed.get(s, []))
        assert [x[1] for x in g] == [o for o, _, _ in lst], s
        assert [x[2] for x in g] == pytest.approx([round(j, 6) for _, j, _ in lst])
        assert [x[3] for x in g] == [c for _, _, c in lst]
        assert [x[0] for x in g] == list(range(1, len(lst) + 1))
    # property: symmetric relation, values in (0, 1], self absent
    for r in got:
        assert 0 < r["jaccard"] <= 1 and r["item_id"] != r["seed_id"]


def test_eligibility_pair_free_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = _pairs(n_users=30, n_items=50, n_rows=70, hot_share=0.1, seed=seed)
        rows += [(100, 48), (101, 48), (101, 49), (102, 49), (102, 47)]
        by_item, exp = _brute(rows, list(range(60)))
        want = {i for i, lst in exp.items() if len(lst) >= 2}
        got = {r["item_id"] for r in overlap.eligible_items(
            overlap.distinct_pairs(_frame(spark, rows))).collect()}
        assert got == want


def test_seed_sample_deterministic_and_bounded(spark):
    cands = spark.range(1000).withColumnRenamed("id", "item_id")
    a = [r["seed_id"] for r in overlap.sample_seeds(cands, 300).collect()]
    b = [r["seed_id"] for r in overlap.sample_seeds(cands, 300).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 300
    assert overlap.sample_seeds(cands.limit(10), 300).count() == 10


def test_hot_user_third_of_rows_salted_matches_sql(spark):
    """One user holds a third of 60k pairs; the seed side is forced past the
    broadcast bound so the salted join runs; checked against DuckDB."""
    import duckdb
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    n = 60_000
    users = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 5_000, n))
    items = rng.integers(0, 3_000, n)
    pdf = pd.DataFrame({"user_id": users.astype("int64"), "item_id": items.astype("int64")})
    pairs = overlap.distinct_pairs(spark.createDataFrame(pdf))
    seeds = overlap.sample_seeds(overlap.eligible_items(pairs), 40)
    got = overlap.jaccard_topk(pairs, seeds, topn=50, max_broadcast_rows=100)
    g = sorted((r["seed_id"], r["item_id"], r["inter"], r["rel_rank"]) for r in got.collect())
    seed_ids = [r["seed_id"] for r in seeds.collect()]
    con = duckdb.connect()
    con.register("raw", pdf)
    con.register("sd", pd.DataFrame({"seed_id": seed_ids}))
    exp = con.sql("""
        WITH p AS (SELECT DISTINCT user_id, item_id FROM raw),
        deg AS (SELECT item_id, count(*) n FROM p GROUP BY item_id),
        i AS (SELECT s.seed_id, b.item_id, count(*) inter FROM sd s JOIN p a ON a.item_id = s.seed_id
              JOIN p b ON b.user_id = a.user_id AND b.item_id <> s.seed_id GROUP BY 1, 2),
        j AS (SELECT i.*, i.inter / (d1.n + d2.n - i.inter) jac FROM i
              JOIN deg d1 ON d1.item_id = i.seed_id JOIN deg d2 ON d2.item_id = i.item_id)
        SELECT seed_id, item_id, inter, rn FROM (
          SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY jac DESC, item_id) rn FROM j)
        WHERE rn <= 50 ORDER BY 1, 2""").fetchall()
    assert g == [tuple(int(x) for x in r) for r in exp]


def test_join_small_broadcast_and_salted_agree(spark):
    from recolens.operators.joins import join_small
    big = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(900)], "k long, v long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 900, 2)], "k long, name string")
    a = sorted(tuple(r) for r in join_small(big, small, ["k"]).collect())
    b = sorted(tuple(r) for r in join_small(big, small, ["k"], max_rows=10, buckets=7).collect())
    assert a == b and len(a) > 0
