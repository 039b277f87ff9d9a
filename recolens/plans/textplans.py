"""Text plans over the driver tables: cleaning variants, data-derived
dictionaries, n-grams, review bags, corpus, TF-IDF over documents, free-text
search, similar items, embedding neighbours.  Each ``*_SQL`` string is the
independent DuckDB form of the Spark plan of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators import corpus as C
from recolens.operators import overlap, similarity, tfidf
from recolens.operators.lexicon import Lexicons, map_tokens, preprocess
from recolens.plans import driver
from recolens.plans import evaluation as E
from recolens.plans import sqltext as S

# Accent folding used to derive an accent-restoration token map from the corpus.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
ACCENT_MAP_TOP = 200       # dictionary built from the most frequent accented tokens
DOC_TOPK = 10              # recommend_from_sim default
APP_TOPK = 9               # app pages show 9 results
APP_MAX_FEATURES = 10_000  # app vectoriser
NB_MAX_FEATURES = 50_000   # notebook vectoriser


# ------------------------------------------------------------- dictionaries

def accent_map_frame(spark: SparkSession, sf_dir: str, top: int = ACCENT_MAP_TOP) -> DataFrame:
    """Token map ``accent-free spelling -> most frequent accented spelling``,
    from the ``top`` most frequent accented tokens of the documents.  Two
    spellings folding to one key: the more frequent wins (then token order)."""
    d = driver.documents(spark, sf_dir)
    toks = d.select(F.explode(T.clean_tokens(T.simple_clean(F.col("text")))).alias("tok"))
    counts = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    folded = F.translate(F.col("tok"), ACCENTED, PLAIN)
    acc = (counts.where(folded != F.col("tok"))
           .orderBy(F.col("n").desc(), F.col("tok").asc()).limit(top))
    return (acc.groupBy(F.translate(F.col("tok"), ACCENTED, PLAIN).alias("key"))
            .agg(F.min_by("tok", F.struct((-F.col("n")).alias("nn"), F.col("tok"))).alias("value")))


def accent_map(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Collected form; bounded by ``ACCENT_MAP_TOP`` entries."""
    return {r["key"]: r["value"] for r in accent_map_frame(spark, sf_dir).collect()}


# ------------------------------------------------------------- Spark plans

def clean_basic(spark, sf):
    d = driver.documents(spark, sf)
    return d.select(F.col("item_id").alias("doc_id"), T.simple_clean(F.col("text")).alias("clean"))


def clean_app(spark, sf):
    d = driver.documents(spark, sf)
    return d.select(F.col("item_id").alias("doc_id"), T.preprocess_text(F.col("text")).alias("clean"))


def token_map(spark, sf):
    m = accent_map(spark, sf)
    d = driver.documents(spark, sf)
    toks = T.clean_tokens(T.simple_clean(F.col("text")))
    return d.select(F.col("item_id").alias("doc_id"), T.join_tokens(map_tokens(toks, m)).alias("mapped"))


def stopword_filter(spark, sf):
    stop = E.doc_stopwords(spark, sf)
    d = driver.documents(spark, sf)
    return d.select(F.col("item_id").alias("doc_id"),
                    preprocess(F.col("text"), Lexicons(stopwords=stop)).alias("clean"))


def clean_full(spark, sf):
    lex = Lexicons(teencode=accent_map(spark, sf), stopwords=E.doc_stopwords(spark, sf))
    d = driver.documents(spark, sf)
    return d.select(F.col("item_id").alias("doc_id"), preprocess(F.col("text"), lex).alias("clean"))


def _doc_segments(spark, sf, stop):
    d = driver.documents(spark, sf)
    return tfidf.single_segment(
        d.select("item_id", preprocess(F.col("text"), Lexicons(stopwords=stop)).alias("text")),
        "item_id", "text")


def ngrams(spark, sf):
    stop = E.doc_stopwords(spark, sf)
    return (tfidf.segment_terms(_doc_segments(spark, sf, stop), multi_segment=False)
            .select(F.col("item_id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf")))


def _clean_reviews(spark, sf, stop):
    return driver.reviews(spark, sf).select(
        "item_id", "seg_order", preprocess(F.col("merged"), Lexicons(stopwords=stop)).alias("text"))


def review_bag(spark, sf):
    stop = E.doc_stopwords(spark, sf)
    return C.review_bag(_clean_reviews(spark, sf, stop))


def _corpus(spark, sf):
    stop = E.doc_stopwords(spark, sf)
    cat = driver.catalog(spark, sf)
    bags = C.review_bag(_clean_reviews(spark, sf, stop))
    return C.corpus(cat, bags, preprocess(F.col("text"), Lexicons(stopwords=stop)))


def corpus_left_join(spark, sf):
    return _corpus(spark, sf)


def length_profile(spark, sf):
    return C.length_profile(_corpus(spark, sf), "corpus")


def _doc_model(spark, sf, folder=None):
    stop = E.doc_stopwords(spark, sf)
    n = driver.documents(spark, sf).count()
    return tfidf.fit_corpus(_doc_segments(spark, sf, stop), n, min_df=2, max_features=NB_MAX_FEATURES,
                            multi_segment=False, folder=folder)


def tfidf_vocab(spark, sf):
    _, model, _ = _doc_model(spark, sf)
    return model.vocab.select("term", F.col("df").cast("long").alias("df"),
                              F.col("tf").cast("long").alias("tf"), F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, sf):
    counts, model, _ = _doc_model(spark, sf)
    return tfidf.transform(counts, model).select(
        F.col("item_id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_similar_topk(spark, sf):
    _, _, w = _doc_model(spark, sf)
    seeds = overlap.sample_seeds(driver.documents(spark, sf).select("item_id"))
    return similarity.cosine_topk_for_seeds(w, seeds, DOC_TOPK)


def text_search_topk(spark, sf):
    """Each benchmark text as a free-text query over the documents."""
    d = driver.documents(spark, sf)
    n = d.count()
    _, model, w = tfidf.fit_corpus(
        tfidf.single_segment(d.select("item_id", T.preprocess_text(F.col("text")).alias("text")),
                             "item_id", "text"), n, min_df=2, max_features=APP_MAX_FEATURES,
        multi_segment=False)
    b = spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet")
    qseg = tfidf.single_segment(
        b.select(F.col("item_id"), T.preprocess_text(F.col("text")).alias("text")), "item_id", "text")
    qw = (tfidf.raw_weights(tfidf.segment_terms(qseg, materialize=False, multi_segment=False), model)
          .withColumnRenamed("item_id", "seed_id"))
    return (similarity.cosine_topk_for_queries(qw, w, APP_TOPK)
            .select(F.col("seed_id").alias("query_id"), "item_id", "similarity", "rank"))


def similar_by_name(spark, sf):
    """P16 + K3 (app page): for every catalog name, its first item (lowest id)
    as the seed; top 9 by TF-IDF over the item descriptions."""
    cat = driver.catalog(spark, sf)
    n = cat.count()
    _, _, w = tfidf.fit_corpus(
        tfidf.single_segment(cat.select("item_id", T.preprocess_text(F.col("text")).alias("text")),
                             "item_id", "text"), n, min_df=2, max_features=APP_MAX_FEATURES,
        multi_segment=False)
    seeds = cat.groupBy("name").agg(F.min("item_id").alias("seed_id"))
    top = similarity.cosine_topk_for_seeds(w, seeds.select("seed_id"), APP_TOPK)
    return top.join(seeds, "seed_id").select("name", "seed_id", "item_id", "similarity", "rank")


def embedding_similar_topk(spark, sf):
    emb = driver.embeddings(spark, sf)
    seeds = overlap.sample_seeds(emb.select("item_id"))
    return similarity.embedding_topk_for_seeds(emb, seeds, DOC_TOPK)


# --------------------------------------------------------------------- SQL

DOCS_CLEAN = S.simple_clean("text")
ACCENT_CTE = f"""atok AS (SELECT tok, count(*) AS n FROM
         (SELECT unnest({S.split_tokens(DOCS_CLEAN)}) AS tok FROM documents) GROUP BY tok),
acc AS (SELECT tok, n FROM atok WHERE translate(tok, {S.q(ACCENTED)}, {S.q(PLAIN)}) <> tok
        ORDER BY n DESC, tok LIMIT {ACCENT_MAP_TOP}),
amap_rows AS (SELECT translate(tok, {S.q(ACCENTED)}, {S.q(PLAIN)}) AS key, tok AS value,
              row_number() OVER (PARTITION BY translate(tok, {S.q(ACCENTED)}, {S.q(PLAIN)})
                                 ORDER BY n DESC, tok) AS rn FROM acc),
amap AS (SELECT map(coalesce(list(key), []), coalesce(list(value), [])) AS m FROM amap_rows WHERE rn = 1)"""


def _map_tokens_sql(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: coalesce(m[t], t))"


CLEAN_BASIC_SQL = f"SELECT doc_id, {DOCS_CLEAN} AS clean FROM documents"
CLEAN_APP_SQL = f"SELECT doc_id, {S.preprocess_text('text')} AS clean FROM documents"
TOKEN_MAP_SQL = ("WITH " + ACCENT_CTE + f"\nSELECT doc_id, array_to_string("
                 f"{_map_tokens_sql(S.split_tokens(DOCS_CLEAN))}, ' ') AS mapped FROM documents, amap")
STOPWORD_FILTER_SQL = ("WITH " + E.STOP_CTE +
                       f"\nSELECT doc_id, {S.preprocess_stop('text', 'sw')} AS clean FROM documents, stop")
_FULL_X1 = f"array_to_string({_map_tokens_sql(S.split_tokens(S.lower_nfc(S.as_text('text'))))}, ' ')"
CLEAN_FULL_SQL = ("WITH " + E.STOP_CTE + ",\n" + ACCENT_CTE +
                  f"\nSELECT doc_id, array_to_string({S.drop_stop(S.split_tokens(S.clean_text_basic(_FULL_X1)), 'sw')}, ' ')"
                  " AS clean FROM documents, stop, amap")

DOC_SEG_SQL = (f"SELECT doc_id AS item_id, CAST(0 AS BIGINT) AS seg_order, "
               f"{S.preprocess_stop('text', 'sw')} AS text FROM documents, stop")
DOC_TFIDF_CTE = ("WITH " + E.STOP_CTE + ",\n"
                 + E._tfidf_cte(DOC_SEG_SQL, "SELECT count(*) FROM documents", 2, NB_MAX_FEATURES))
NGRAMS_SQL = DOC_TFIDF_CTE + "\nSELECT item_id AS doc_id, term, CAST(tf AS BIGINT) AS tf FROM terms"
TFIDF_VOCAB_SQL = (DOC_TFIDF_CTE + "\nSELECT term, CAST(df AS BIGINT) AS df, CAST(ctf AS BIGINT) AS tf, "
                   "round(idf, 6) AS idf FROM idf")
TFIDF_WEIGHTS_SQL = (DOC_TFIDF_CTE + "\nSELECT w.item_id AS doc_id, w.term, round(w.w / n.norm, 6) AS weight "
                     "FROM w JOIN norms n ON w.item_id = n.item_id")
TFIDF_SIMILAR_SQL = (DOC_TFIDF_CTE + """,
seeds AS (SELECT doc_id AS seed_id FROM documents
          ORDER BY (doc_id * 1103515245 + 12387) % 2147483648, doc_id LIMIT 300),
""" + E._cosine_topk_sql(DOC_TOPK) + "\nSELECT seed_id, item_id, similarity, rank FROM ranked")

_REVIEWS_CLEAN = ("SELECT conv_id AS item_id, turn AS seg_order, "
                  + S.preprocess_stop("concat_ws(' ', coalesce(role, ''), coalesce(text, ''))", "sw")
                  + " AS text FROM conversations, stop")
BAG_CTE = ("WITH " + E.STOP_CTE + f""",
rclean AS ({_REVIEWS_CLEAN}),
bags AS (SELECT item_id, string_agg(text, ' ' ORDER BY seg_order) AS bag FROM rclean
         WHERE item_id IS NOT NULL GROUP BY item_id)""")
REVIEW_BAG_SQL = BAG_CTE + "\nSELECT item_id, bag FROM bags"
CORPUS_CTE = BAG_CTE + f""",
corpus AS (SELECT p.p_partkey AS item_id,
                  {S.preprocess_stop("concat_ws(' ', p.p_name, p.p_brand, p.p_type)", 'sw')} || ' ' || coalesce(b.bag, '') AS corpus
           FROM part p CROSS JOIN stop LEFT JOIN bags b ON b.item_id = p.p_partkey)"""
CORPUS_SQL = CORPUS_CTE + "\nSELECT item_id, corpus FROM corpus"
LENGTH_PROFILE_SQL = CORPUS_CTE + """
SELECT count(*) AS count, round(avg(length(corpus)), 6) AS mean, round(stddev_samp(length(corpus)), 6) AS std,
       CAST(min(length(corpus)) AS BIGINT) AS min,
       round(quantile_cont(length(corpus), 0.25), 6) AS p25, round(quantile_cont(length(corpus), 0.5), 6) AS p50,
       round(quantile_cont(length(corpus), 0.75), 6) AS p75, CAST(max(length(corpus)) AS BIGINT) AS max
FROM corpus"""

_APP_DOC_SEG = (f"SELECT doc_id AS item_id, CAST(0 AS BIGINT) AS seg_order, {S.preprocess_text('text')} AS text "
                "FROM documents")
_Q_SEG = (f"SELECT item_id, CAST(0 AS BIGINT) AS seg_order, {S.preprocess_text('text')} AS text "
          "FROM benchmark")
TEXT_SEARCH_SQL = ("WITH " + E._tfidf_cte(_APP_DOC_SEG, "SELECT count(*) FROM documents", 2, APP_MAX_FEATURES)
                   + f""",
qtok AS (SELECT item_id, {S.word_tokens('text')} AS toks FROM ({_Q_SEG})),
qterms AS (SELECT item_id, term, count(*) AS tf FROM (
             SELECT item_id, unnest(toks) AS term FROM qtok
             UNION ALL SELECT item_id, unnest(list_transform(range(1, len(toks)),
                                              lambda i: toks[i] || ' ' || toks[i + 1])) FROM qtok)
           GROUP BY item_id, term),
sw AS (SELECT q.item_id AS seed_id, q.term, q.tf * i.idf AS w_q FROM qterms q JOIN idf i ON q.term = i.term),
dots AS (SELECT sw.seed_id, w.item_id, sum(w.w * sw.w_q) AS dot FROM sw JOIN w ON sw.term = w.term
         GROUP BY sw.seed_id, w.item_id),
qn AS (SELECT seed_id, sqrt(sum(w_q * w_q)) AS q_norm FROM sw GROUP BY seed_id),
cos AS (SELECT d.seed_id, d.item_id, round(d.dot / (qn.q_norm * n.norm), 6) AS similarity
        FROM dots d JOIN qn ON d.seed_id = qn.seed_id JOIN norms n ON d.item_id = n.item_id)
SELECT seed_id AS query_id, item_id, similarity,
       row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, item_id) AS rank
FROM cos WHERE similarity > 0 QUALIFY rank <= {APP_TOPK}""")

CAT_TEXT_SQL = "concat_ws(' ', p_name, p_brand, p_type)"
_CAT_SEG = (f"SELECT p_partkey AS item_id, CAST(0 AS BIGINT) AS seg_order, "
            f"{S.preprocess_text(CAT_TEXT_SQL)} AS text FROM part")
SIMILAR_BY_NAME_SQL = ("WITH " + E._tfidf_cte(_CAT_SEG, "SELECT count(*) FROM part", 2, APP_MAX_FEATURES) + """,
names AS (SELECT p_name AS name, min(p_partkey) AS seed_id FROM part GROUP BY p_name),
seeds AS (SELECT seed_id FROM names),
""" + E._cosine_topk_sql(APP_TOPK) + """
SELECT n.name, r.seed_id, r.item_id, r.similarity, r.rank FROM ranked r JOIN names n ON n.seed_id = r.seed_id""")

EMBEDDING_SIMILAR_SQL = ("WITH seeds AS (SELECT vec_id AS seed_id FROM embeddings "
                         "ORDER BY (vec_id * 1103515245 + 12387) % 2147483648, vec_id LIMIT 300),\n"
                         + E._embedding_topk_sql(DOC_TOPK)
                         + "\nSELECT seed_id, item_id, similarity, rank FROM eranked")
