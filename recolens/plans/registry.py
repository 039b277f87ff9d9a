"""Registered queries ``name -> (spark, sf_dir) -> DataFrame`` and their
DuckDB oracle SQL.  Queries without an oracle are checked by row count only
(models with randomness, hash sampling) and by unit tests on fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recolens.operators import overlap, ranking
from recolens.plans import evaluation as E
from recolens.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------- relevance and seeds

@register("distinct_pairs", E.DISTINCT_PAIRS_SQL)
def q_distinct_pairs(spark, sf):
    return E.pairs(spark, sf)


@register("item_users", E.ITEM_USERS_SQL)
def q_item_users(spark, sf):
    return overlap.item_user_counts(E.pairs(spark, sf))


@register("seed_eligibility", E.ELIGIBILITY_SQL)
def q_seed_eligibility(spark, sf):
    return E.eligible(spark, sf)


@register("seed_sample", E.SEED_SAMPLE_SQL)
def q_seed_sample(spark, sf):
    return E.seeds(spark, sf)


@register("jaccard_topk", E.JACCARD_SQL)
def q_jaccard_topk(spark, sf):
    return E.relevance(spark, sf)


# ---------------------------------------------------------- evaluation

@register("tfidf_recs", E.TFIDF_RECS_SQL)
def q_tfidf_recs(spark, sf):
    sd = cut_lineage(E.seeds(spark, sf))
    return E.tfidf_recs(spark, sf, sd)


@register("eval_rows", E.EVAL_ROWS_SQL)
def q_eval_rows(spark, sf):
    return ranking.round_metrics(E.eval_rows(spark, sf))


def _metric_query(metric: str) -> Query:
    def fn(spark, sf):
        return ranking.round_metrics(E.eval_rows(spark, sf)).select(
            "method", "K", "seed_id", metric)
    return fn


for _m, _name in (("precision", "precision_at_k"), ("map", "map_at_k"),
                  ("ndcg_bin", "ndcg_binary"), ("ndcg_grd", "ndcg_graded")):
    register(_name, E.EVAL_CTE + f"\nSELECT method, K, seed_id, round({_m}, 6) AS {_m} FROM evalrows")(
        _metric_query(_m))


@register("eval_summary", E.EVAL_SUMMARY_SQL)
def q_eval_summary(spark, sf):
    return E.eval_summary(spark, sf)


@register("eval_summary_all")          # + Word2Vec method: model output, rows only
def q_eval_summary_all(spark, sf):
    return E.eval_summary(spark, sf, E.ALL_METHODS)


# ------------------------------------------------------------------ text

from recolens.plans import textplans as TP  # noqa: E402

for _name, _fn, _sql in (
        ("clean_basic", TP.clean_basic, TP.CLEAN_BASIC_SQL),
        ("clean_app", TP.clean_app, TP.CLEAN_APP_SQL),
        ("token_map", TP.token_map, TP.TOKEN_MAP_SQL),
        ("stopword_filter", TP.stopword_filter, TP.STOPWORD_FILTER_SQL),
        ("clean_full", TP.clean_full, TP.CLEAN_FULL_SQL),
        ("ngrams", TP.ngrams, TP.NGRAMS_SQL),
        ("review_bag", TP.review_bag, TP.REVIEW_BAG_SQL),
        ("corpus_left_join", TP.corpus_left_join, TP.CORPUS_SQL),
        ("length_profile", TP.length_profile, TP.LENGTH_PROFILE_SQL),
        ("tfidf_vocab", TP.tfidf_vocab, TP.TFIDF_VOCAB_SQL),
        ("tfidf_weights", TP.tfidf_weights, TP.TFIDF_WEIGHTS_SQL),
        ("tfidf_similar_topk", TP.tfidf_similar_topk, TP.TFIDF_SIMILAR_SQL),
        ("text_search_topk", TP.text_search_topk, TP.TEXT_SEARCH_SQL),
        ("similar_by_name", TP.similar_by_name, TP.SIMILAR_BY_NAME_SQL),
        ("embedding_similar_topk", TP.embedding_similar_topk, TP.EMBEDDING_SIMILAR_SQL)):
    register(_name, _sql)(_fn)


# --------------------------------------------------- ratings, ids, ALS, lookups

from recolens.plans import ratingplans as RP  # noqa: E402

for _name, _fn, _sql in (
        ("rating_parse", RP.rating_parse, RP.RATING_PARSE_SQL),
        ("rating_unparsed", RP.rating_unparsed, RP.RATING_UNPARSED_SQL),
        ("id_encode", RP.id_encode, RP.ID_ENCODE_SQL),
        ("distinct_users", RP.distinct_users, RP.DISTINCT_USERS_SQL),
        ("distinct_item_names", RP.distinct_item_names, RP.DISTINCT_ITEM_NAMES_SQL),
        ("missing_labels", RP.missing_labels, RP.MISSING_LABELS_SQL),
        ("user_recs_join", RP.user_recs_join, RP.USER_RECS_JOIN_SQL),
        ("als_split", RP.als_split, RP.ALS_SPLIT_SQL),
        ("baseline_trials", RP.baseline_trials, RP.BASELINE_TRIALS_SQL),
        ("baseline_best", RP.baseline_best, RP.BASELINE_BEST_SQL),
        # model outputs (seeded MLlib solvers): row-count checks + unit tests
        ("als_grid", RP.als_grid, None),
        ("best_trial", RP.best_trial, None),
        ("als_recommend", RP.als_recommend, None),
        ("doc_embedding", RP.doc_embedding, None)):
    register(_name, _sql)(_fn)


# ----------------------------------------- top k of every item, indexed search

from recolens.plans import indexplans as IP  # noqa: E402

for _name, (_fn, _sql) in IP.QUERIES.items():
    register(_name, _sql)(_fn)


# ------------------------------------------------- files, dictionaries, serving

from recolens.plans import sourceplans as SP  # noqa: E402

for _name, (_fn, _sql) in SP.QUERIES.items():
    register(_name, _sql)(_fn)
