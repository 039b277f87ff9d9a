"""All-items Jaccard by light pairs and heavy bitmaps against plain sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from recolens.operators import co_overlap


def table(seed, users, items, heavy):
    rng = random.Random(seed)
    out = set()
    for u in range(users):
        out |= {(u, rng.randrange(items)) for _ in range(rng.randrange(1, 6))}
    for u in range(heavy):          # heavy users hold a third of the items or more
        out |= {(10_000 + u, i) for i in range(items + 40) if rng.random() < 0.4}
    out |= {(20_000, 900 + i) for i in range(30)}        # equal sets of one heavy user
    return sorted(out)


def brute(pairs, k):
    sets = {}
    for u, i in pairs:
        sets.setdefault(i, set()).add(u)
    out = {}
    for a, ua in sets.items():
        found = sorted((-len(ua & ub) / len(ua | ub), b) for b, ub in sets.items() if b != a and ua & ub)
        out[a] = [(b, -s) for s, b in found[:k]]
    return {a: v for a, v in out.items() if v}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.seed_id, r["rank"])):
        out.setdefault(r.seed_id, []).append((r.item_id, r.similarity))
    return out


@pytest.mark.parametrize("seed,heavy,degree,block,k", [
    (1, 0, None, 1024, 5), (2, 3, 10, 8, 4), (3, 70, 10, 16, 10), (4, 2, 0, 8, 3), (5, 5, 10, 1024, 200)])
def test_all_items_topk_equals_sets(spark, seed, heavy, degree, block, k):
    pairs = table(seed, 60, 50, heavy)
    frame = spark.createDataFrame(pairs, "user_id long, item_id long").repartition(4)
    got = listed(co_overlap.all_items_topk(frame, k, degree, block, part_queries=7))
    assert got == brute(pairs, k)


def test_heavy_users_make_no_pair_rows(spark):
    pairs = table(9, 40, 300, 2)
    frame = spark.createDataFrame(pairs, "user_id long, item_id long")
    heavy = co_overlap.heavy_users(frame, 20)
    assert heavy.count() == 3
    light = co_overlap.light_overlaps(frame, heavy)
    assert light.count() <= sum(1 for _ in range(40)) * 25
    assert co_overlap.all_items_topk(frame.where("user_id < 0"), 3).count() == 0


def test_partners_leave_tasks_few_a_seed(spark, monkeypatch):
    pairs = table(11, 50, 200, 3) + [(30_000 + u, 2_000 + i) for u in range(3) for i in range(60)]
    frame = spark.createDataFrame(pairs, "user_id long, item_id long").repartition(4)
    heavy = co_overlap.heavy_users(frame, 70)
    whole = {(r.a, r.b): r.light for r in co_overlap.light_overlaps(frame, heavy).collect()}
    items = co_overlap.item_classes(frame).select("item_id", "n_users").join(co_overlap.item_bitmaps(frame, heavy), "item_id", "left")
    numbered = co_overlap.numbered_items(items.fillna(0, ["n_heavy"]))
    ids = {r.number: r.item_id for r in numbered.collect()}
    got = [(ids[r.a], ids[r.b], r.light) for r in co_overlap.light_partners(frame, heavy, numbered, 2).collect()]
    assert all(whole[min(a, b), max(a, b)] == light for a, b, light in got) and len(set(got)) == len(got)
    large = [x for x in got if x[0] >= 2_000]
    assert len(large) == 60 * 2 and sum(a >= 2_000 for a, _ in whole) == 60 * 59 / 2  # before: every pair was a row
    monkeypatch.setattr(co_overlap, "PARTNERS_AT_ONCE", 100)  # seeds of more are counted by rows
    frame = frame.where("user_id < 10000 or user_id >= 30000")
    assert listed(co_overlap.all_items_topk(frame, 4)) == brute([p for p in pairs if p[0] < 10_000 or p[0] >= 30_000], 4)


def test_partners_of_whole_seeds_in_parts(monkeypatch):
    rng = random.Random(3)
    lists = [sorted(rng.sample(range(40), rng.randrange(2, 9))) for _ in range(80)]
    degrees = co_overlap.Degrees.__new__(co_overlap.Degrees)
    degrees.first, degrees.users, degrees.heavy = np.array([0, 20]), np.array([90, 99]), np.array([0, 0])
    table = pa.table({"block": [1] * 80, "items": pa.array(lists, pa.list_(pa.int32()))})
    want = co_overlap._partners(degrees, 40, 3, np.zeros(0, np.int32), 50)(table)
    monkeypatch.setattr(co_overlap, "PARTNERS_AT_ONCE", 5)
    got = co_overlap._partners(degrees, 40, 3, np.zeros(0, np.int32), 50)(table)
    assert sorted(map(tuple, map(dict.values, got.to_pylist()))) == sorted(map(tuple, map(dict.values, want.to_pylist())))
    assert {(r["a"], r["b"]): r["light"] for r in want.to_pylist()} == {
        (a, b): n for a in range(1, 40, 3) for b in range(40) if a != b and (n := sum(a in x and b in x for x in lists))}
