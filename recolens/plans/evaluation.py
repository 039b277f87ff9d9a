"""The offline evaluation plan: Jaccard relevance -> seeds -> recommendations
per method -> ranking metrics -> summary (reference sections 4 and 6).

Spark builders take ``(spark, sf_dir)``; the ``*_SQL`` strings are the
independent DuckDB forms used as the correctness oracle.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators import overlap, ranking, similarity, tfidf, wordvec
from recolens.operators.lexicon import Lexicons, preprocess
from recolens.plans import driver, sqltext as S
from recolens.session import cut_lineage

STOPWORDS_TOP = 20   # data-derived stopword list: most frequent tokens by document frequency


# ------------------------------------------------------------------ Spark

def pairs(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Distinct (user, item) pairs; ``materialize`` writes them once when a
    plan reads them several times (seeds, relevance, degrees)."""
    p = overlap.distinct_pairs(driver.interactions(spark, sf_dir))
    return cut_lineage(p) if materialize else p


def eligible(spark: SparkSession, sf_dir: str, pairs_df: DataFrame | None = None) -> DataFrame:
    cat = driver.catalog(spark, sf_dir).select("item_id")
    p = pairs_df if pairs_df is not None else pairs(spark, sf_dir)
    return overlap.eligible_items(p).join(cat, "item_id", "left_semi")


def seeds(spark: SparkSession, sf_dir: str, pairs_df: DataFrame | None = None) -> DataFrame:
    return overlap.sample_seeds(eligible(spark, sf_dir, pairs_df))


def relevance(spark: SparkSession, sf_dir: str, seed_df: DataFrame | None = None,
              pairs_df: DataFrame | None = None) -> DataFrame:
    p = pairs_df if pairs_df is not None else pairs(spark, sf_dir, materialize=True)
    sd = seed_df if seed_df is not None else cut_lineage(seeds(spark, sf_dir, p))
    return overlap.jaccard_topk(p, sd)


def doc_stopwords(spark: SparkSession, sf_dir: str, n: int = STOPWORDS_TOP) -> list[str]:
    """The ``n`` tokens present in most documents (ties: token order).  The
    list is bounded by ``n`` (a top-n), so it is collected and inlined."""
    d = driver.documents(spark, sf_dir)
    # distinct tokens per document inside the row: no (doc, token) shuffle
    toks = d.select(F.explode(F.array_distinct(T.clean_tokens(T.simple_clean(F.col("text"))))).alias("tok"))
    top = (toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
           .orderBy(F.col("df").desc(), F.col("tok").asc()).limit(n))
    return [r[0] for r in top.collect()]


def corpus_segments(catalog: DataFrame, reviews: DataFrame, lex: Lexicons) -> DataFrame:
    """Catalog text (segment 0) + its reviews in order.

    catalog: (item_id, text); reviews: (item_id, seg_order, merged)."""
    s0 = catalog.select("item_id", F.lit(0).cast("long").alias("seg_order"),
                        preprocess(F.col("text"), lex).alias("text"))
    rv = (reviews.join(catalog.select("item_id"), "item_id", "left_semi")
          .select("item_id", (F.col("seg_order") + 1).alias("seg_order"),
                  preprocess(F.col("merged"), lex).alias("text")))
    return s0.unionByName(rv)


def part_segments(spark: SparkSession, sf_dir: str, stop: list[str]) -> DataFrame:
    return corpus_segments(driver.catalog(spark, sf_dir), driver.reviews(spark, sf_dir),
                           Lexicons(stopwords=stop))


def fit_catalog_tfidf(catalog: DataFrame, reviews: DataFrame, lex: Lexicons):
    """M1 over the catalog corpus: materialised document-term table and vocabulary."""
    return tfidf.fit_corpus(corpus_segments(catalog, reviews, lex), catalog.count(), min_df=2,
                            max_features=50_000)


def fit_part_tfidf(spark: SparkSession, sf_dir: str, stop: list[str]):
    return fit_catalog_tfidf(driver.catalog(spark, sf_dir), driver.reviews(spark, sf_dir),
                             Lexicons(stopwords=stop))


def tfidf_recs(spark: SparkSession, sf_dir: str, seed_df: DataFrame, k: int = ranking.REC_TOPN,
               stop: list[str] | None = None, fitted=None) -> DataFrame:
    if fitted is None:
        stop = doc_stopwords(spark, sf_dir) if stop is None else stop
        fitted = fit_part_tfidf(spark, sf_dir, stop)
    _, _, w = fitted
    return similarity.cosine_topk_for_seeds(w, seed_df, k)


def embedding_recs(spark: SparkSession, sf_dir: str, seed_df: DataFrame,
                   k: int = ranking.REC_TOPN) -> DataFrame:
    return similarity.embedding_topk_for_seeds(driver.embeddings(spark, sf_dir), seed_df, k)


def wordvec_recs_from(segments: DataFrame, seed_df: DataFrame, k: int = ranking.REC_TOPN) -> DataFrame:
    """M4 re-aimed: Word2Vec item vectors over the cleaned corpus segments."""
    toks = cut_lineage(wordvec.segment_tokens(segments))
    model = wordvec.fit(toks)
    vecs = cut_lineage(wordvec.item_vectors(model, toks))
    return similarity.embedding_topk_for_seeds(vecs, seed_df, k)


def wordvec_recs(spark: SparkSession, sf_dir: str, seed_df: DataFrame, k: int = ranking.REC_TOPN,
                 stop: list[str] | None = None) -> DataFrame:
    stop = doc_stopwords(spark, sf_dir) if stop is None else stop
    return wordvec_recs_from(part_segments(spark, sf_dir, stop), seed_df, k)


METHODS = ("tfidf", "embedding")
ALL_METHODS = ("tfidf", "embedding", "word2vec")


def eval_rows_frames(catalog: DataFrame, reviews: DataFrame, interactions: DataFrame,
                     lexicons, embeddings: DataFrame | None = None,
                     methods=METHODS) -> DataFrame:
    """A18 over any catalog / reviews / interactions frames: every method x
    seed x K in one plan (U1 over the methods present; a method without its
    input - e.g. no embedding table - is skipped, M11).

    catalog (item_id, text), reviews (item_id, seg_order, merged),
    interactions (user_id, item_id), embeddings (item_id, embedding).
    ``lexicons`` is a ``Lexicons`` or a zero-argument callable returning one
    (derived dictionaries).  The relevance chain (pairs -> seeds -> Jaccard)
    and the corpus chain (dictionaries -> document-term table -> vocabulary)
    do not depend on each other, so they run as concurrent Spark jobs."""
    methods = [m for m in methods if m != "embedding" or embeddings is not None]
    cat_ids = catalog.select(F.col("item_id").alias("seed_id"))

    def relevance_chain():
        p = cut_lineage(overlap.distinct_pairs(interactions))
        elig = overlap.eligible_items(p).join(catalog.select("item_id"), "item_id", "left_semi")
        sd = cut_lineage(overlap.sample_seeds(elig))
        return sd, cut_lineage(overlap.jaccard_topk(p, sd))

    def corpus_chain():
        if "tfidf" not in methods and "word2vec" not in methods:
            return None, None
        lex = lexicons() if callable(lexicons) else lexicons
        return lex, (fit_catalog_tfidf(catalog, reviews, lex) if "tfidf" in methods else None)

    with ThreadPoolExecutor(max_workers=2) as pool:
        f_rel, f_corpus = pool.submit(relevance_chain), pool.submit(corpus_chain)
        sd, rel = f_rel.result()
        lex, fitted = f_corpus.result()
    builders = {
        "tfidf": (lambda: similarity.cosine_topk_for_seeds(fitted[2], sd, ranking.REC_TOPN), cat_ids),
        "embedding": (lambda: similarity.embedding_topk_for_seeds(embeddings, sd, ranking.REC_TOPN),
                      embeddings.select(F.col("item_id").alias("seed_id")) if embeddings is not None else None),
        "word2vec": (lambda: wordvec_recs_from(corpus_segments(catalog, reviews, lex), sd), cat_ids),
    }
    recs = ranking.union_methods([builders[m][0]().withColumn("method", F.lit(m)) for m in methods])
    eval_seeds = ranking.union_methods([
        sd.join(builders[m][1], "seed_id", "left_semi").withColumn("method", F.lit(m)) for m in methods])
    return ranking.evaluate(recs.select("method", "seed_id", "item_id", "rank"), rel, eval_seeds)


def eval_rows(spark: SparkSession, sf_dir: str, methods=METHODS) -> DataFrame:
    """The evaluation over the driver tables (stopwords derived from the documents)."""
    return eval_rows_frames(
        driver.catalog(spark, sf_dir), driver.reviews(spark, sf_dir),
        driver.interactions(spark, sf_dir),
        lambda: Lexicons(stopwords=doc_stopwords(spark, sf_dir)),
        driver.embeddings(spark, sf_dir), methods)


def eval_summary(spark: SparkSession, sf_dir: str, methods=METHODS) -> DataFrame:
    return ranking.summarize(eval_rows(spark, sf_dir, methods))


# -------------------------------------------------------------------- SQL

PAIRS_CTE = f"""inter_rows AS ({driver.INTERACTIONS_SQL}),
pairs AS (SELECT DISTINCT user_id, item_id FROM inter_rows
          WHERE user_id IS NOT NULL AND item_id IS NOT NULL)"""

ELIGIBLE_CTE = PAIRS_CTE + """,
co AS (SELECT a.item_id, count(DISTINCT b.item_id) AS n_co
       FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.item_id <> b.item_id
       GROUP BY a.item_id),
eligible AS (SELECT item_id FROM co WHERE n_co >= 2 AND item_id IN (SELECT p_partkey FROM part))"""

SEEDS_CTE = ELIGIBLE_CTE + """,
seeds AS (SELECT item_id AS seed_id FROM eligible
          ORDER BY (item_id * 1103515245 + 12387) % 2147483648, item_id LIMIT 300)"""

RELEVANCE_CTE = SEEDS_CTE + """,
deg AS (SELECT item_id, count(*) AS n_users FROM pairs GROUP BY item_id),
inter AS (SELECT s.seed_id, b.item_id, count(*) AS inter
          FROM seeds s JOIN pairs a ON a.item_id = s.seed_id
          JOIN pairs b ON b.user_id = a.user_id AND b.item_id <> s.seed_id
          GROUP BY s.seed_id, b.item_id),
jac AS (SELECT i.seed_id, i.item_id, i.inter, ds.n_users + di.n_users - i.inter AS union_size,
               i.inter / (ds.n_users + di.n_users - i.inter) AS jaccard
        FROM inter i JOIN deg ds ON ds.item_id = i.seed_id JOIN deg di ON di.item_id = i.item_id),
rel AS (SELECT seed_id, item_id, CAST(inter AS BIGINT) AS inter, CAST(union_size AS BIGINT) AS union_size,
               round(jaccard, 6) AS jaccard,
               row_number() OVER (PARTITION BY seed_id ORDER BY jaccard DESC, item_id) AS rel_rank
        FROM jac QUALIFY rel_rank <= 1000)"""

DISTINCT_PAIRS_SQL = "WITH " + PAIRS_CTE + "\nSELECT user_id, item_id FROM pairs"
ITEM_USERS_SQL = ("WITH " + PAIRS_CTE +
                  "\nSELECT item_id, count(*) AS n_users FROM pairs GROUP BY item_id")
ELIGIBILITY_SQL = "WITH " + ELIGIBLE_CTE + "\nSELECT item_id FROM eligible"
SEED_SAMPLE_SQL = "WITH " + SEEDS_CTE + "\nSELECT seed_id FROM seeds"
JACCARD_SQL = ("WITH " + RELEVANCE_CTE +
               "\nSELECT seed_id, item_id, inter, union_size, jaccard, rel_rank FROM rel")

STOP_CTE = f"""dtok AS (SELECT DISTINCT doc_id, unnest({S.split_tokens(S.simple_clean('text'))}) AS tok
         FROM documents),
stop AS (SELECT list(tok ORDER BY df DESC, tok) AS sw FROM
         (SELECT tok, count(*) AS df FROM dtok GROUP BY tok ORDER BY df DESC, tok LIMIT {STOPWORDS_TOP}))"""


def _tfidf_cte(segments_sql: str, n_docs_sql: str, min_df: int = 2, max_features: int = 50_000) -> str:
    """CTEs seg -> terms -> vocab -> w, norms over a segment relation."""
    return f"""seg AS ({segments_sql}),
segtok AS (SELECT item_id, seg_order, {S.word_tokens('text')} AS toks FROM seg),
segne AS (SELECT * FROM segtok WHERE len(toks) > 0),
uni AS (SELECT item_id, unnest(toks) AS term FROM segne),
bi AS (SELECT item_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term
       FROM segne),
edge AS (SELECT item_id, toks[len(toks)] AS last_tok,
                lead(toks[1]) OVER (PARTITION BY item_id ORDER BY seg_order) AS next_first FROM segne),
cross_bi AS (SELECT item_id, last_tok || ' ' || next_first AS term FROM edge WHERE next_first IS NOT NULL),
terms AS (SELECT item_id, term, count(*) AS tf FROM
          (SELECT * FROM uni UNION ALL SELECT * FROM bi UNION ALL SELECT * FROM cross_bi)
          GROUP BY item_id, term),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM terms GROUP BY term
          HAVING count(*) >= {min_df} ORDER BY ctf DESC, term LIMIT {max_features}),
ndocs AS (SELECT ({n_docs_sql}) AS n),
idf AS (SELECT term, df, ctf, ln((1.0 + n) / (df + 1.0)) + 1.0 AS idf FROM vocab, ndocs),
w AS (SELECT t.item_id, t.term, t.tf * i.idf AS w FROM terms t JOIN idf i ON t.term = i.term),
norms AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY item_id)"""


def _part_segments_sql() -> str:
    cat_text = "concat_ws(' ', p_name, p_brand, p_type)"
    review_text = "concat_ws(' ', coalesce(role, ''), coalesce(text, ''))"
    return (f"SELECT p_partkey AS item_id, CAST(0 AS BIGINT) AS seg_order, "
            f"{S.preprocess_stop(cat_text, 'sw')} AS text FROM part, stop "
            f"UNION ALL SELECT conv_id, turn + 1, {S.preprocess_stop(review_text, 'sw')} "
            f"FROM conversations, stop WHERE conv_id IN (SELECT p_partkey FROM part)")


def _cosine_topk_sql(k: int) -> str:
    """CTEs sw (seed weights) -> dots -> cos -> ranked, over w / norms / seeds."""
    return f"""sw AS (SELECT s.seed_id, w.term, w.w AS w_q FROM w JOIN seeds s ON w.item_id = s.seed_id),
dots AS (SELECT sw.seed_id, w.item_id, sum(w.w * sw.w_q) AS dot FROM sw JOIN w ON sw.term = w.term
         WHERE w.item_id <> sw.seed_id GROUP BY sw.seed_id, w.item_id),
qn AS (SELECT seed_id, sqrt(sum(w_q * w_q)) AS q_norm FROM sw GROUP BY seed_id),
cos AS (SELECT d.seed_id, d.item_id, round(d.dot / (qn.q_norm * n.norm), 6) AS similarity
        FROM dots d JOIN qn ON d.seed_id = qn.seed_id JOIN norms n ON d.item_id = n.item_id),
ranked AS (SELECT seed_id, item_id, similarity,
                  row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, item_id) AS rank
           FROM cos WHERE similarity > 0 QUALIFY rank <= {k})"""


def _embedding_topk_sql(k: int) -> str:
    return f"""ev AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ecos AS (SELECT s.seed_id, v.item_id,
                round(list_cosine_similarity(sv.e, v.e), 6) AS similarity
         FROM seeds s JOIN ev sv ON sv.item_id = s.seed_id JOIN ev v ON v.item_id <> s.seed_id),
eranked AS (SELECT seed_id, item_id, similarity,
                   row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, item_id) AS rank
            FROM ecos QUALIFY rank <= {k})"""


EVAL_CTE = ("WITH " + RELEVANCE_CTE + ",\n" + STOP_CTE + ",\n"
            + _tfidf_cte(_part_segments_sql(), "SELECT count(*) FROM part") + ",\n"
            + _cosine_topk_sql(ranking.REC_TOPN) + ",\n"
            + _embedding_topk_sql(ranking.REC_TOPN) + """,
recs AS (SELECT 'tfidf' AS method, seed_id, item_id, rank FROM ranked
         UNION ALL SELECT 'embedding', seed_id, item_id, rank FROM eranked),
eval_seeds AS (SELECT 'tfidf' AS method, seed_id FROM seeds WHERE seed_id IN (SELECT p_partkey FROM part)
               UNION ALL SELECT 'embedding', seed_id FROM seeds WHERE seed_id IN (SELECT vec_id FROM embeddings)),
ks AS (SELECT unnest([5, 10, 20]) AS K),
nrel AS (SELECT seed_id, count(*) AS n_rel FROM rel GROUP BY seed_id),
hits AS (SELECT r.method, r.seed_id, r.item_id, r.rank,
                CASE WHEN l.jaccard IS NULL THEN 0 ELSE 1 END AS hit, coalesce(l.jaccard, 0.0) AS gain
         FROM recs r LEFT JOIN rel l ON r.seed_id = l.seed_id AND r.item_id = l.item_id),
hits2 AS (SELECT *, sum(hit) OVER (PARTITION BY method, seed_id ORDER BY rank
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hits FROM hits),
got AS (SELECT method, seed_id, K, sum(hit) AS hits, sum(hit * cum_hits / rank) AS ap_num,
               sum(hit / log2(rank + 1)) AS dcg_bin, sum((pow(2.0, gain) - 1.0) / log2(rank + 1)) AS dcg_grd
        FROM hits2, ks WHERE rank <= K GROUP BY method, seed_id, K),
igrd AS (SELECT seed_id, K, sum((pow(2.0, jaccard) - 1.0) / log2(rel_rank + 1)) AS idcg_grd
         FROM rel, ks WHERE rel_rank <= K GROUP BY seed_id, K),
base AS (SELECT e.method, e.seed_id, ks.K, coalesce(n.n_rel, 0) AS n_rel,
                coalesce(g.hits, 0) AS hits, coalesce(g.ap_num, 0.0) AS ap_num,
                coalesce(g.dcg_bin, 0.0) AS dcg_bin, coalesce(g.dcg_grd, 0.0) AS dcg_grd,
                coalesce(i.idcg_grd, 0.0) AS idcg_grd
         FROM eval_seeds e CROSS JOIN ks
         LEFT JOIN nrel n ON n.seed_id = e.seed_id
         LEFT JOIN got g ON g.method = e.method AND g.seed_id = e.seed_id AND g.K = ks.K
         LEFT JOIN igrd i ON i.seed_id = e.seed_id AND i.K = ks.K),
base2 AS (SELECT *, CASE WHEN n_rel > 0 THEN list_sum(list_transform(range(1, n_rel + 1),
                                   lambda i: 1.0 / log2(i + 1))) ELSE 0.0 END AS idcg_bin FROM base),
evalrows AS (SELECT method, K, seed_id, hits / K AS precision,
                    ap_num / greatest(least(n_rel, K), 1) AS map,
                    CASE WHEN idcg_bin > 0 THEN dcg_bin / idcg_bin ELSE 0.0 END AS ndcg_bin,
                    CASE WHEN idcg_grd > 0 THEN dcg_grd / idcg_grd ELSE 0.0 END AS ndcg_grd,
                    CAST(n_rel AS BIGINT) AS n_rel
             FROM base2)""")

EVAL_ROWS_SQL = EVAL_CTE + """
SELECT method, K, seed_id, round(precision, 6) AS precision, round(map, 6) AS map,
       round(ndcg_bin, 6) AS ndcg_bin, round(ndcg_grd, 6) AS ndcg_grd, n_rel FROM evalrows"""

EVAL_SUMMARY_SQL = EVAL_CTE + """
SELECT method, K, round(avg(precision), 6) AS precision, round(avg(map), 6) AS map,
       round(avg(ndcg_bin), 6) AS ndcg_bin, round(avg(ndcg_grd), 6) AS ndcg_grd,
       count(*) AS n_seeds, method || '_' || CAST(K AS VARCHAR) AS label
FROM evalrows GROUP BY method, K ORDER BY K, method"""

TFIDF_RECS_SQL = ("WITH " + SEEDS_CTE + ",\n" + STOP_CTE + ",\n"
                  + _tfidf_cte(_part_segments_sql(), "SELECT count(*) FROM part") + ",\n"
                  + _cosine_topk_sql(ranking.REC_TOPN)
                  + "\nSELECT seed_id, item_id, similarity, rank FROM ranked")
