"""Whole-table similarity plans: the top k of every item, and indexed search.

The ``*_SQL`` strings compare all pairs; the Spark plans reach the same rows through
blocks with bounds (``operators.blocks``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators import co_overlap, dense_index, docvec, overlap, ranking, sentvec, sparse_index, tfidf, wordvec
from recolens.operators.lexicon import Lexicons, preprocess, replace_substrings
from recolens.plans import driver
from recolens.plans import evaluation as E
from recolens.plans import sqltext as S
from recolens.plans import textplans as TP
from recolens.session import cut_lineage, removed_folder, scratch_folder


def tfidf_all_items_topk(spark, sf):
    """The ten most similar documents of every document."""
    folder = scratch_folder(spark, "terms")
    _, model, w = TP._doc_model(spark, sf, folder)
    return sparse_index.all_items_topk(w, model, TP.DOC_TOPK, spent=folder)


def text_search_blocks(spark, sf):
    """K4/M3 through the block index: the rows of ``text_search_topk``."""
    d = driver.documents(spark, sf)
    folder = scratch_folder(spark, "terms")
    _, model, w = tfidf.fit_corpus(
        tfidf.single_segment(d.select("item_id", T.preprocess_text(F.col("text")).alias("text")), "item_id", "text"),
        d.count(), min_df=2, max_features=TP.APP_MAX_FEATURES, multi_segment=False, folder=folder)
    terms = sparse_index.term_numbers(model)
    index = sparse_index.build(sparse_index.unit_vectors(w, terms), terms, terms.count())
    removed_folder(spark, folder)
    b = spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet")
    asked = tfidf.single_segment(b.select("item_id", T.preprocess_text(F.col("text")).alias("text")), "item_id", "text")
    qw = (tfidf.raw_weights(tfidf.segment_terms(asked, materialize=False, multi_segment=False), model)
          .withColumnRenamed("item_id", "seed_id"))
    return (sparse_index.search(qw, index, TP.APP_TOPK).top
            .select(F.col("seed_id").alias("query_id"), "item_id", "similarity", "rank"))


def jaccard_all_items_topk(spark, sf):
    """The ten items with the largest co-reviewer overlap, for every item."""
    top = co_overlap.all_items_topk(E.pairs(spark, sf, materialize=True), TP.DOC_TOPK)
    return top.select("seed_id", "item_id", F.round("similarity", 6).alias("jaccard"), F.col("rank").alias("rel_rank"))


def embedding_all_items_topk(spark, sf):
    """The ten nearest vectors of every vector by cosine, exact."""
    return dense_index.all_items_topk(driver.embeddings(spark, sf), TP.DOC_TOPK)


def embedding_probe_topk(spark, sf):
    """J6 by the index alone: as many of the nearest clusters as a sample asks for.
    Approximate; the tests measure its recall."""
    index = dense_index.build(driver.embeddings(spark, sf))
    queries = index.vectors.select(F.col("item_id").alias("seed_id"), "embedding")
    return dense_index.probe_topk(index, queries, TP.DOC_TOPK, dense_index.choose_probes(index, TP.DOC_TOPK))


def vector_dot_topk(spark, sf):
    """K6/M10 on given factors: the ten largest inner products of every vector, itself included."""
    v = driver.embeddings(spark, sf)
    index = dense_index.build(v, cosine=False)
    return dense_index.topk(v.withColumnRenamed("item_id", "seed_id"), index, TP.DOC_TOPK).top


def _doc_tokens(spark, sf):
    """(item_id, toks): whitespace tokens of the cleaned documents."""
    stop = E.doc_stopwords(spark, sf)
    return cut_lineage(driver.documents(spark, sf).select(
        "item_id", T.split_tokens(preprocess(F.col("text"), Lexicons(stopwords=stop))).alias("toks")))


def doc_vectors(spark, sf):
    """M4: paragraph vectors of the documents with the reference's settings, as its
    evaluation takes them: inferred once the words are trained."""
    toks = _doc_tokens(spark, sf)
    return docvec.infer(toks, docvec.fit(toks)).withColumnRenamed("item_id", "doc_id")


def sentence_vectors(spark, sf):
    """M5: weighted word vectors of the documents without their common direction."""
    toks = _doc_tokens(spark, sf)
    words = wordvec.fit(toks).getVectors()
    return (sentvec.sentence_vectors(toks, words, wordvec.VECTOR_SIZE)
            .select(F.col("item_id").alias("doc_id"), F.col("embedding").cast("array<float>")))


EMBEDDING_ALL_SQL = ("WITH seeds AS (SELECT vec_id AS seed_id FROM embeddings),\n" + E._embedding_topk_sql(TP.DOC_TOPK)
                     + "\nSELECT seed_id, item_id, similarity, rank FROM eranked")
DOT_SQL = f"""WITH ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dots AS (SELECT a.vec_id AS seed_id, b.vec_id AS item_id, round(list_inner_product(a.e, b.e), 6) AS similarity
         FROM ev a JOIN ev b ON len(a.e) = len(b.e))
SELECT seed_id, item_id, similarity,
       row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, item_id) AS rank
FROM dots QUALIFY rank <= {TP.DOC_TOPK}"""

JACCARD_ALL_SQL = "WITH " + E.PAIRS_CTE + f""",
deg AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY item_id),
inter AS (SELECT a.item_id AS seed_id, b.item_id, count(*) AS n
          FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id),
jac AS (SELECT i.seed_id, i.item_id, i.n / (s.n + o.n - i.n) AS jaccard
        FROM inter i JOIN deg s ON s.item_id = i.seed_id JOIN deg o ON o.item_id = i.item_id)
SELECT seed_id, item_id, round(jaccard, 6) AS jaccard,
       row_number() OVER (PARTITION BY seed_id ORDER BY jaccard DESC, item_id) AS rel_rank
FROM jac QUALIFY rel_rank <= {TP.DOC_TOPK}"""

TFIDF_ALL_SQL = (TP.DOC_TFIDF_CTE + ",\nseeds AS (SELECT doc_id AS seed_id FROM documents),\n"
                 + E._cosine_topk_sql(TP.DOC_TOPK) + "\nSELECT seed_id, item_id, similarity, rank FROM ranked")

ELIGIBLE_LEVELS = (1, 3, 5)
LARGE_DICTIONARY = 500


def seed_eligibility_levels(spark, sf):
    """P22 at other thresholds than the evaluation's: (min_rel, item_id)."""
    p = E.pairs(spark, sf, materialize=True)
    return ranking.union_methods([overlap.eligible_items(p, m).withColumn("min_rel", F.lit(m).cast("long"))
                                  for m in ELIGIBLE_LEVELS])


def frequent_tokens(spark, sf, n):
    """The ``n`` tokens in most documents, most frequent first; bounded by ``n``."""
    toks = driver.documents(spark, sf).select(F.explode(F.array_distinct(T.clean_tokens(T.simple_clean(F.col("text"))))).alias("tok"))
    top = toks.groupBy("tok").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "tok").limit(n)
    return [r.tok for r in top.orderBy(F.desc("df"), "tok").collect()]


def replace_substrings_large(spark, sf):
    """T3 with a dictionary beyond nested calls: frequent tokens, most frequent first, lose
    their first letter, so replaced text holds later keys."""
    mapping = {k: k[1:] + "_" for k in frequent_tokens(spark, sf, LARGE_DICTIONARY)}
    d = driver.documents(spark, sf)
    return d.select(F.col("item_id").alias("doc_id"), replace_substrings(T.lower_nfc(T.as_text("text")), mapping).alias("replaced"))


ELIGIBLE_LEVELS_SQL = "WITH " + E.ELIGIBLE_CTE + f"""
SELECT CAST(m AS BIGINT) AS min_rel, item_id FROM co, (SELECT unnest({list(ELIGIBLE_LEVELS)}) AS m) WHERE n_co >= m"""
REPLACE_SQL = f"""WITH dtok AS (SELECT DISTINCT doc_id, unnest({S.split_tokens(S.simple_clean('text'))}) AS tok FROM documents),
top AS (SELECT tok, count(*) AS df FROM dtok GROUP BY tok ORDER BY df DESC, tok LIMIT {LARGE_DICTIONARY}),
keys AS (SELECT list(tok ORDER BY df DESC, tok) AS ks FROM top)
SELECT doc_id, list_reduce(ks, lambda t, k: replace(t, k, ' ' || substr(k, 2) || '_ '), {S.lower_nfc(S.as_text('text'))}) AS replaced
FROM documents, keys"""

QUERIES = {
    "seed_eligibility_levels": (seed_eligibility_levels, ELIGIBLE_LEVELS_SQL),
    "replace_substrings_large": (replace_substrings_large, REPLACE_SQL),
    "tfidf_all_items_topk": (tfidf_all_items_topk, TFIDF_ALL_SQL),
    "jaccard_all_items_topk": (jaccard_all_items_topk, JACCARD_ALL_SQL),
    "embedding_all_items_topk": (embedding_all_items_topk, EMBEDDING_ALL_SQL),
    "embedding_probe_topk": (embedding_probe_topk, None),
    "doc_vectors": (doc_vectors, None),
    "sentence_vectors": (sentence_vectors, None),
    "vector_dot_topk": (vector_dot_topk, DOT_SQL),
    "text_search_blocks": (text_search_blocks, TP.TEXT_SEARCH_SQL),
}
