"""eval_case fixtures: no hits, all hits, fewer than K recommendations,
n_rel < K, ties - against a plain-Python statement of each metric."""

from math import log2

import pytest

from recolens.operators import ranking


def py_metrics(recs, gains, k, ideal="full"):
    rec = recs[:k]
    rel = set(gains)
    hits = sum(1 for x in rec if x in rel)
    precision = hits / k
    h, s = 0, 0.0
    for i, r in enumerate(rec, 1):
        if r in rel:
            h += 1
            s += h / i
    ap = s / max(min(len(rel), k), 1)
    dcg = sum((1.0 if x in rel else 0.0) / log2(i + 1) for i, x in enumerate(rec, 1))
    n_ideal = len(rel) if ideal == "full" else min(len(rel), k)
    idcg = sum(1.0 / log2(i + 1) for i in range(1, n_ideal + 1))
    nb = dcg / idcg if idcg > 0 else 0.0
    dg = sum((2.0 ** gains.get(x, 0.0) - 1.0) / log2(i + 1) for i, x in enumerate(rec, 1))
    ig = sorted(gains.values(), reverse=True)[:k]
    idg = sum((2.0 ** g - 1.0) / log2(i + 1) for i, g in enumerate(ig, 1))
    ng = dg / idg if idg > 0 else 0.0
    return precision, ap, nb, ng


CASES = {
    # seed: (recommendations in rank order, relevance gains)
    1: ([10, 11, 12, 13, 14, 15], {20: 0.5, 21: 0.25}),                  # no hits
    2: (list(range(30, 55)), {i: 1.0 / (i - 29) for i in range(30, 55)}),  # all hits
    3: ([40, 41], {40: 0.3, 42: 0.6, 43: 0.1}),                           # fewer than K recs
    4: ([50, 51, 52, 53, 54, 55, 56], {51: 0.2}),                         # n_rel < K
    5: ([60, 61, 62, 63, 64], {61: 0.5, 63: 0.5, 70: 0.5}),               # tied gains
    6: ([], {80: 0.4, 81: 0.4}),                                          # no recommendation at all
}


def _frames(spark):
    recs = [("m", s, it, i + 1) for s, (items, _) in CASES.items() for i, it in enumerate(items)]
    rel = []
    for s, (_, gains) in CASES.items():
        ordered = sorted(gains.items(), key=lambda kv: (-kv[1], kv[0]))
        rel += [(s, it, g, r + 1) for r, (it, g) in enumerate(ordered)]
    r = spark.createDataFrame(recs, "method string, seed_id long, item_id long, rank int")
    l = spark.createDataFrame(rel, "seed_id long, item_id long, jaccard double, rel_rank int")
    seeds = spark.createDataFrame([("m", s) for s in CASES], "method string, seed_id long")
    return r, l, seeds


@pytest.mark.parametrize("ideal", ["full", "at_k"])
def test_metrics_match_python(spark, ideal):
    r, l, seeds = _frames(spark)
    out = ranking.evaluate(r, l, seeds, ideal=ideal).collect()
    assert len(out) == len(CASES) * 3
    for row in out:
        items, gains = CASES[row["seed_id"]]
        p, ap, nb, ng = py_metrics(items, gains, row["K"], ideal)
        assert row["precision"] == pytest.approx(p)
        assert row["map"] == pytest.approx(ap)
        assert row["ndcg_bin"] == pytest.approx(nb)
        assert row["ndcg_grd"] == pytest.approx(ng)
        assert row["n_rel"] == len(gains)
        assert 0.0 <= row["ndcg_grd"] <= 1.0 + 1e-12


def test_summary_and_labels(spark):
    r, l, seeds = _frames(spark)
    s = ranking.summarize(ranking.evaluate(r, l, seeds)).collect()
    assert [(x["K"], x["label"]) for x in s] == [(5, "m_5"), (10, "m_10"), (20, "m_20")]
    assert all(x["n_seeds"] == len(CASES) for x in s)


def test_top_k_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 4, 0.9), (1, 9, 0.1)],
                               "g long, item long, score double")
    got = [(r["item"], r["rank"]) for r in ranking.top_k(df, ["g"], "score", "item", 3)
           .orderBy("rank").collect()]
    assert got == [(4, 1), (3, 2), (5, 3)]


def test_window_group_limit_in_plan(spark):
    df = spark.range(100).selectExpr("id % 7 AS g", "id AS item", "rand(1) AS score")
    q = ranking.top_k(df, ["g"], "score", "item", 3)
    assert "WindowGroupLimit" in q._jdf.queryExecution().executedPlan().toString()
