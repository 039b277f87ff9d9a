"""Property checks (hypothesis): random recommendation / relevance lists,
all metrics computed in one Spark plan, compared with the plain-Python
definitions; bounds and monotonicity of the definitions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recolens.operators import ranking

from test_ranking import py_metrics

case = st.fixed_dictionaries({
    "recs": st.lists(st.integers(0, 40), max_size=25, unique=True),
    "rel": st.dictionaries(st.integers(0, 40), st.floats(0.01, 1.0), max_size=30),
})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(case, min_size=5, max_size=12))
def test_random_cases_match_python(spark, cases):
    cases = [c for c in cases if c["rel"]]          # evaluation seeds always have relevance
    if not cases:
        return
    recs, rel, seeds = [], [], []
    for s, c in enumerate(cases):
        seeds.append(("m", s))
        recs += [("m", s, it, i + 1) for i, it in enumerate(c["recs"])]
        ordered = sorted(c["rel"].items(), key=lambda kv: (-kv[1], kv[0]))
        rel += [(s, it, g, r + 1) for r, (it, g) in enumerate(ordered)]
    r = spark.createDataFrame(recs, "method string, seed_id long, item_id long, rank int")
    l = spark.createDataFrame(rel, "seed_id long, item_id long, jaccard double, rel_rank int")
    sd = spark.createDataFrame(seeds, "method string, seed_id long")
    for row in ranking.evaluate(r, l, sd).collect():
        c = cases[row["seed_id"]]
        p, ap, nb, ng = py_metrics(c["recs"], c["rel"], row["K"])
        assert row["precision"] == pytest.approx(p)
        assert row["map"] == pytest.approx(ap)
        assert row["ndcg_bin"] == pytest.approx(nb)
        assert row["ndcg_grd"] == pytest.approx(ng)
        for v in (row["precision"], row["map"], row["ndcg_bin"], row["ndcg_grd"]):
            assert -1e-12 <= v <= 1 + 1e-12


@given(case, st.sampled_from([5, 10, 20]))
def test_definitions_bounded(c, k):
    if not c["rel"]:
        return
    p, ap, nb, ng = py_metrics(c["recs"], c["rel"], k)
    assert 0 <= p <= 1 and 0 <= ap <= 1 + 1e-12 and 0 <= nb <= 1 + 1e-12 and 0 <= ng <= 1 + 1e-12
    # a perfect list (relevant items by gain) has graded nDCG 1
    best = [i for i, _ in sorted(c["rel"].items(), key=lambda kv: (-kv[1], kv[0]))]
    assert py_metrics(best, c["rel"], k)[3] == pytest.approx(1.0)
