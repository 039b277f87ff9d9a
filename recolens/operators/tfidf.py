"""TF-IDF over item corpora (A6, M1-M3), in long form ``(item_id, term, weight)``.

Vectoriser semantics (scikit-learn ``TfidfVectorizer`` defaults, public
documentation): tokens are maximal runs of >= 2 word characters, 1- and
2-grams, ``min_df`` counted in documents, ``max_features`` keeps the terms with
the highest corpus frequency (ties: term ascending), raw counts as tf,
``idf = ln((1 + N) / (1 + df)) + 1``, rows L2-normalised.

Corpora are given as *segments* ``(item_id, seg_order, text)``: an item's
document is its segments joined by spaces in ``seg_order`` (item text first,
then its reviews).  Terms are counted per segment and summed per item, so no
item's text is ever gathered into one row; the only cross-segment terms, the
bigrams spanning a segment boundary, come from each segment's first and last
token.

Plan shape: one partial-aggregated shuffle for (item, term) counts, one for
(term) statistics, an exact distributed top-n for the vocabulary (bounded by
``max_features``, so broadcasting it is safe), and per-item norms as a
partial aggregate.  The weight table itself is never shuffled by item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators.joins import fits
from recolens.session import cut_lineage, written


@dataclass
class TfidfModel:
    vocab: DataFrame          # (term, df, tf, idf)
    n_docs: int
    max_features: int | None
    ngram_max: int = 2


def tokenize_segments(segments: DataFrame) -> DataFrame:
    """``(item_id, seg_order, toks)`` for every segment."""
    return segments.select("item_id", "seg_order", T.word_tokens(F.col("text")).alias("toks"))


EDGE_CHUNK = 4096   # segments per first-level chunk of the boundary-bigram pass


def boundary_bigrams(seg: DataFrame, chunk: int = EDGE_CHUNK) -> DataFrame:
    """Bigrams across segment boundaries: last token of a non-empty segment +
    first token of the next non-empty segment of the same item.

    Two levels, so a hot item's segments never sit in one window: pairs
    inside chunks of ``chunk`` consecutive order values come from a window
    per (item, chunk); pairs across chunk borders come from each chunk's
    first and last token (a partial aggregate) and a window over the chunks
    of the item (one row per chunk)."""
    edge = (seg.where(F.size("toks") > 0)
            .select("item_id", "seg_order",
                    F.element_at("toks", -1).alias("last_tok"),
                    F.element_at("toks", 1).alias("first_tok"),
                    F.floor(F.col("seg_order").cast("double") / F.lit(float(chunk)))
                    .cast("long").alias("chunk")))
    w1 = Window.partitionBy("item_id", "chunk").orderBy("seg_order")
    inner = (edge.withColumn("next_first", F.lead("first_tok").over(w1))
             .where(F.col("next_first").isNotNull())
             .select("item_id", F.concat_ws(" ", "last_tok", "next_first").alias("term")))
    ends = edge.groupBy("item_id", "chunk").agg(
        F.min_by("first_tok", "seg_order").alias("c_first"),
        F.max_by("last_tok", "seg_order").alias("c_last"))
    w2 = Window.partitionBy("item_id").orderBy("chunk")
    across = (ends.withColumn("next_first", F.lead("c_first").over(w2))
              .where(F.col("next_first").isNotNull())
              .select("item_id", F.concat_ws(" ", "c_last", "next_first").alias("term")))
    return inner.unionByName(across)


def segment_terms(segments: DataFrame, ngram_max: int = 2, materialize: bool = True,
                  multi_segment: bool = True, folder: str | None = None) -> DataFrame:
    """Term occurrences ``(item_id, term, tf)`` of each item's joined document
    (the document-term table).  With ``materialize`` it is written once to the
    reliable checkpoint folder: the vocabulary fit and the weights both read
    it, and cleaning upstream runs exactly once.  ``multi_segment=False``
    declares one segment per item (no boundary bigrams to find): then texts are dealt by
    item before they are taken apart, and their terms, several times as large, stay there."""
    if not multi_segment:                       # a number of its own: packed partitions would spill
        segments = segments.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    seg = tokenize_segments(segments)
    grams = F.concat(F.col("toks"), T.bigrams(F.col("toks"))) if ngram_max >= 2 else F.col("toks")
    parts = [seg.select("item_id", F.explode(grams).alias("term"))]
    if ngram_max >= 2 and multi_segment:
        parts.append(boundary_bigrams(seg))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dtm = out.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return written(dtm, "terms", folder) if materialize else dtm


def single_segment(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("item_id"), F.lit(0).alias("seg_order"),
                       F.col(text_col).alias("text"))


def top_terms(stats: DataFrame, n: int, tie_bound: int = 200_000) -> DataFrame:
    """Exactly the ``n`` terms with the highest corpus frequency (ties: term
    ascending), without gathering the candidates in one task.

    A histogram of frequencies (one row per distinct value; its top ``n``
    rows are a bounded collect) gives the threshold frequency ``T``: all
    terms above ``T`` are in; of the terms at ``T`` the first ``need`` by
    term are in.  That tie group is ordered by a distributed sort
    (``ids.dense_ids``) when it is large, by a small top-n otherwise."""
    from recolens.operators.ids import dense_ids
    stats = written(stats, "stats")
    hist = (stats.groupBy("tf").agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.col("tf").desc()).limit(n).collect())
    above, threshold = 0, None
    for r in hist:
        if above + r["c"] >= n:
            threshold = r["tf"]
            break
        above += r["c"]
    if threshold is None:                       # fewer than n candidates
        return stats
    need = n - above
    ties = stats.where(F.col("tf") == threshold)
    if not fits(ties, tie_bound):
        ranked = dense_ids(ties, "term", "__pos")
        keep = ties.join(ranked.where(F.col("__pos") < need).select("term"), "term", "left_semi")
    else:
        keep = ties.orderBy("term").limit(need)
    return stats.where(F.col("tf") > threshold).unionByName(keep)


def fit(term_counts: DataFrame, n_docs: int, min_df: int = 2, max_df: int | None = None,
        max_features: int | None = 50_000, materialize: bool = True) -> TfidfModel:
    """A6 + M1 fit: document frequency, corpus frequency, vocabulary, idf.
    The vocabulary (bounded by ``max_features``) is materialised once."""
    stats = term_counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                           F.sum("tf").alias("tf"))
    stats = stats.where(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.where(F.col("df") <= max_df)
    if max_features is not None:
        stats = top_terms(stats, max_features)
    vocab = stats.withColumn(
        "idf", F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0)
    if materialize:
        vocab = cut_lineage(vocab)
    return TfidfModel(vocab, n_docs, max_features)


def _vocab_side(model: TfidfModel) -> DataFrame:
    v = model.vocab.select("term", "idf")
    # the vocabulary is bounded by max_features: a proven broadcast bound
    return F.broadcast(v) if model.max_features is not None else v


def raw_weights(term_counts: DataFrame, model: TfidfModel) -> DataFrame:
    """Un-normalised ``(item_id, term, w = tf * idf)`` restricted to the vocabulary."""
    return (term_counts.join(_vocab_side(model), "term")
            .select("item_id", "term", (F.col("tf") * F.col("idf")).alias("w")))


def norms(weights: DataFrame) -> DataFrame:
    """Per-item L2 norm (partial aggregate: one row per item leaves each task)."""
    return weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def transform(term_counts: DataFrame, model: TfidfModel) -> DataFrame:
    """M1 transform: L2-normalised ``(item_id, term, weight)``."""
    w = raw_weights(term_counts, model)
    return (w.join(norms(w), "item_id")
            .select("item_id", "term", (F.col("w") / F.col("norm")).alias("weight")))


def fit_corpus(segments: DataFrame, n_docs: int, min_df: int = 2,
               max_features: int | None = 50_000, ngram_max: int = 2,
               max_df: int | None = None, multi_segment: bool = True, folder: str | None = None):
    """Convenience: counts, fitted model and un-normalised weights of a corpus.  The counts
    lie at ``folder``, if given, for a caller that removes them once the weights are read."""
    counts = segment_terms(segments, ngram_max, multi_segment=multi_segment, folder=folder)
    model = fit(counts, n_docs, min_df, max_df, max_features)
    model.ngram_max = ngram_max
    return counts, model, raw_weights(counts, model)
