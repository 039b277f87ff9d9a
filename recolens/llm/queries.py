"""Registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.llm import (backoff, bitsliced, bpe, line_dedup, lsh_forest, marked_words, packing, quality,
                          secrets_forest, toxicity, turn_repair, warc, whitening)
from recolens.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_crf_toxicity")
def q_crf_toxicity(spark, sf):
    return toxicity.score(load_table(spark, sf, "documents"), load_table(spark, sf, "labels"))


@register("op2_byte_bpe")
def q_byte_bpe(spark, sf):
    return bpe.digests(load_table(spark, sf, "documents"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 9 * count(*) >= 4 * (any_value(x.n) + any_value(y.n))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, min(r.b) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM d JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@register("op3_ngram_jaccard_join", JACCARD_SQL)
def q_ngram_jaccard_join(spark, sf):
    return lsh_forest.jaccard_join(load_table(spark, sf, "documents"))


@register("op4_vector_packing")
def q_vector_packing(spark, sf):
    return packing.piece_digests(packing.pack_documents(
        load_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


BACKOFF_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT r, v AS g1, a AS x1, a || ' ' || v AS g2, b || ' ' || a AS x2, b || ' ' || a || ' ' || v AS g3
  FROM (SELECT *, lag(v) OVER o AS a, lag(v, 2) OVER o AS b
        FROM (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d)
        WINDOW o AS (PARTITION BY r ORDER BY i))),
c1 AS (SELECT g1, count(*) AS c FROM p GROUP BY g1),
c2 AS (SELECT g2, count(*) AS c FROM p WHERE g2 IS NOT NULL GROUP BY g2),
c3 AS (SELECT g3, count(*) AS c FROM p WHERE g3 IS NOT NULL GROUP BY g3),
s AS (
  SELECT p.r, CASE
    WHEN c3.c >= 2 THEN ln(c3.c) - ln(x2.c)
    WHEN c2.c >= 2 THEN ln(c2.c) - ln(x1.c) + CASE WHEN p.g3 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(c1.c) - ln((SELECT count(*) FROM p)) + CASE WHEN p.g2 IS NULL THEN 0 ELSE ln(0.4) END
         + CASE WHEN p.g3 IS NULL THEN 0 ELSE ln(0.4) END END AS v
  FROM p JOIN c1 ON p.g1 = c1.g1
  LEFT JOIN c2 ON p.g2 = c2.g2 LEFT JOIN c3 ON p.g3 = c3.g3
  LEFT JOIN c1 x1 ON p.x1 = x1.g1 LEFT JOIN c2 x2 ON p.x2 = x2.g2),
t AS (SELECT r, sum(v) AS score, count(*) AS n FROM s GROUP BY r)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_words, round(coalesce(t.score, 0.0), 4) AS score,
       round(t.score / t.n, 6) AS mean_score
FROM d LEFT JOIN t ON d.r = t.r
"""


@register("op5_stupid_backoff", BACKOFF_SQL)
def q_stupid_backoff(spark, sf):
    scored = backoff.score(load_table(spark, sf, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"),
                         F.round("mean_score", 6).alias("mean_score"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op6_bit_sliced_top_k", TOP_K_SQL)
def q_bit_sliced_top_k(spark, sf):
    rows = load_table(spark, sf, "embeddings")
    return bitsliced.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


@register("op7_secret_forest")
def q_secret_forest(spark, sf):
    return secrets_forest.scored(load_table(spark, sf, "documents"))


@register("op8_quality_cascade")
def q_quality_cascade(spark, sf):
    return quality.cascade(load_table(spark, sf, "documents"))


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line,
         list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (SELECT line, list_distinct(any_value(w)) AS w, min((doc_id, i)) AS first FROM l WHERE len(w) >= 1 GROUP BY line),
t AS (SELECT line, len(w) AS n, first, unnest(w) AS tok FROM s),
o AS (
  SELECT a.line AS a, b.line AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM t a JOIN t b ON a.tok = b.tok AND a.first < b.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.line, b.line HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
g AS (
  SELECT l.doc_id, l.i FROM l JOIN s ON l.line = s.line
  WHERE (l.doc_id, l.i) > s.first OR l.line IN (SELECT b FROM o)),
k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id,
       coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)), '') AS text,
       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@register("op9_line_dedup", LINE_DEDUP_SQL)
def q_line_dedup(spark, sf):
    return line_dedup.dedup_lines(load_table(spark, sf, "documents"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
             (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)),
           'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@register("op10_warc_salvage", WARC_SQL)
def q_warc_salvage(spark, sf):
    return warc.archive_round_trip(load_table(spark, sf, "pages"), min_bytes=0)


@register("op11_embedding_whitening")
def q_embedding_whitening(spark, sf):
    """Deviations beyond 64 bits are null here; the operator's own are decimals."""
    return (whitening.whiten(load_table(spark, sf, "embeddings"))
            .withColumn("deviation", F.col("deviation").try_cast("long")))


@register("op12_marked_words")
def q_marked_words(spark, sf):
    return marked_words.digests(load_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op13_turn_repair")
def q_turn_repair(spark, sf):
    return turn_repair.repair(load_table(spark, sf, "conversations"))
