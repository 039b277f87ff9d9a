"""Spark query vs its DuckDB oracle on sf0.001 for a fast subset of the
registry (row count, column names, raw values; order-insensitive)."""

import duckdb
import pytest

import __spark_entry__ as E
from recolens.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["distinct_pairs", "seed_eligibility", "seed_sample", "jaccard_topk", "clean_full",
        "token_map", "review_bag", "length_profile", "rating_parse", "rating_unparsed",
        "id_encode", "missing_labels", "user_recs_join", "similar_by_name",
        "embedding_similar_topk", "tfidf_vocab"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(cols, values):
    out = []
    for v in values:
        out.append(tuple(tuple(x) if isinstance(x, list) else x for x in v))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _rows(cols, [[r[c] for c in cols] for r in df.collect()])
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = _rows(cols, [[r[i] for i in idx] for r in rel.fetchall()])
    assert len(got) == len(want)
    assert got == want
