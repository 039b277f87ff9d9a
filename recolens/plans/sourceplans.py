"""Plans over the file sources and sinks and the serving functions.

Files are written below the shared checkpoint folder and read back, so the rows
compared with SQL have been through the reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recolens.functions import columns as C
from recolens.functions import text as T
from recolens.operators import factor, similarity
from recolens.operators.lexicon import Lexicons, preprocess
from recolens.plans import driver, indexplans
from recolens.plans import evaluation as E
from recolens.plans import ratingplans as RP
from recolens.plans import serve
from recolens.plans import sqltext as S
from recolens.plans import textplans as TP
from recolens.session import checkpoint_dir
from recolens.sources import dictionaries, files
from recolens.sources.tables import load_table

CSV = {"header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
       "ignoreTrailingWhiteSpace": "false"}
#: Characters that UTF-8, cp1258 and their CSV files all keep.
PLAIN = "[^ -~\nàâäçèéêëîïôöùûüß]"


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_encodings(spark, sf):
    """Documents written as UTF-8, UTF-8 with a byte-order mark and cp1258 into one
    folder, read back file by file."""
    path = _folder(spark, "csv-encodings")
    d = load_table(spark, sf, "documents").select("doc_id", F.regexp_replace(T.as_text("text"), PLAIN, "").alias("text"))
    source, target, _ = files.cp1258_table()
    kinds = ((0, "UTF-8", "doc_id", F.col("text")), (1, "UTF-8", files.BOM + "doc_id", F.col("text")),
             (2, "ISO-8859-1", "doc_id", F.translate("text", target, source)))
    for rest, encoding, head, text in kinds:
        (d.where(F.pmod("doc_id", F.lit(3)) == rest).select(F.col("doc_id").alias(head), text.alias("text"))
         .write.mode("append").options(**CSV, encoding=encoding).csv(path))
    return files.read_csv_safely(spark, path).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


ITEM_ROLES = (C.Role("item_id", ("hotel id", "id"), required=True), C.Role("name", ("hotel name",), required=True),
              C.Role("brand", ("hotel brand",)), C.Role("type", ("hotel type",)))


def csv_catalog(spark, sf):
    """A catalog file with untidy headers, read to roles, its description put
    together and its ids in the type of the table they are joined with."""
    path = _folder(spark, "csv-catalog")
    part = load_table(spark, sf, "part")
    (part.select(F.col("p_partkey").alias(" Hotel-ID "), F.col("p_name").alias("HOTEL NAME"),
                 F.col("p_brand").alias("Hotel.Brand"), F.col("p_type").alias(" hotel_type"))
     .write.options(**CSV).csv(path))
    read = C.with_role_names(C.trim_columns(files.read_csv_safely(spark, path)), ITEM_ROLES)
    C.require_columns(read, ["item_id", "name"], "catalog")
    read = C.with_joined_default(read, "description", ["name", "brand", "type"])
    read = C.align_key_type(read, "item_id", part, "p_partkey")
    return read.join(part.select(F.col("p_partkey").alias("item_id")), "item_id", "left_semi").select("item_id", "name", "description")


def dictionary_file(spark, sf):
    """A tab-separated dictionary with padded keys, blank lines and keys without a value."""
    path = _folder(spark, "dictionary")
    c = load_table(spark, sf, "customer")
    line = (F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).when(F.col("c_custkey") % 7 == 0, F.lit("  "))
            .otherwise(F.concat(F.lit("  "), "c_name", F.lit(" \t "), "c_mktsegment", F.lit("\r"))))
    c.select(line.alias("value")).write.text(path)
    return dictionaries.read_dict(spark, path)


def embedding_store(spark, sf):
    """S3: vectors written, read back and listed by component."""
    path = _folder(spark, "embeddings")
    files.save_embeddings(driver.embeddings(spark, sf), path)
    return (files.load_embeddings(spark, path).select("item_id", F.posexplode("embedding").alias("pos", "x"))
            .select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x").cast("double").alias("x")))


def recommend_user(spark, sf):
    """The table of recommendations as a file, the first user's rows joined by name."""
    path = _folder(spark, "recommendations")
    files.write_table(RP.user_recs_table(spark, sf), path, "csv")
    recs = files.read_recommendations(spark, path)
    first = serve.user_list(recs).first()
    cat = driver.catalog(spark, sf).select("item_id", F.col("display_name").alias("name"))
    return (serve.recommend(recs, cat, first.UserName if first else "")
            .select(F.col("UserName").alias("user_name"), F.col("RecommendedHotel").alias("recommended"), "item_id"))


def table_profile(spark, sf):
    """Rows and columns of a table."""
    return files.profile(load_table(spark, sf, "part")).select("n_rows", F.col("n_cols").cast("long").alias("n_cols"))


def table_head(spark, sf):
    """K7: the first rows by key."""
    return files.head(load_table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey"))


def clean_lexicons(spark, sf):
    """Frequent tokens as stopwords, as wrong words and as words to translate."""
    toks = indexplans.frequent_tokens(spark, sf, 60)
    lex = Lexicons(stopwords=toks[:20], wrong=toks[20:40], en_vi={t: f"x{t} vi" for t in toks[40:]})
    return driver.documents(spark, sf).select(F.col("item_id").alias("doc_id"), preprocess(F.col("text"), lex).alias("clean"))


def similar_by_id(spark, sf):
    """The nearest vectors of the item with the smallest id, which must exist."""
    v = driver.embeddings(spark, sf)
    seed = serve.seed_by_id(v, v.agg(F.min("item_id")).first()[0])
    return similarity.embedding_topk_for_seeds(v, seed, TP.APP_TOPK)


def recommend_named(spark, sf):
    """Top items of given factors with the names of the catalog, where it has one."""
    top = indexplans.vector_dot_topk(spark, sf).select(
        F.col("seed_id").cast("int").alias("userId"), F.col("item_id").cast("int").alias("itemId"),
        F.col("similarity").alias("score"), "rank")
    return factor.with_names(top, driver.catalog(spark, sf))


_CLEAN = S.split_tokens(S.clean_text_basic(S.lower_nfc(S.as_text("text"))))
_TRANSLATED = (f"array_to_string(list_transform(list_filter({_CLEAN}, lambda t: NOT list_contains(ks[21:40], t)), "
               "lambda t: CASE WHEN list_contains(ks[41:60], lower(t)) THEN 'x' || lower(t) || ' vi' ELSE t END), ' ')")

QUERIES = {
    "csv_encodings": (csv_encodings, "SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~\\nàâäçèéêëîïôöùûüß]', '', 'g') AS text "
                                     "FROM documents"),
    "csv_catalog": (csv_catalog, "SELECT p_partkey AS item_id, p_name AS name, concat_ws(' ', p_name, p_brand, p_type) AS description "
                                 "FROM part"),
    "dictionary_file": (dictionary_file, """SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS value
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 <> 0"""),
    "embedding_store": (embedding_store, """SELECT vec_id AS item_id, generate_subscripts(embedding, 1) AS pos,
CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""),
    "recommend_user": (recommend_user, f"SELECT * FROM ({RP.USER_RECS_JOIN_SQL}) "
                                       "QUALIFY user_name = min(user_name) OVER ()"),
    "table_profile": (table_profile, "SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE part)) AS n_cols FROM part"),
    "table_head": (table_head, "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5"),
    "clean_lexicons": (clean_lexicons, f"""WITH dtok AS (SELECT DISTINCT doc_id, unnest({S.split_tokens(S.simple_clean('text'))}) AS tok
         FROM documents),
top AS (SELECT tok, count(*) AS df FROM dtok GROUP BY tok ORDER BY df DESC, tok LIMIT 60),
keys AS (SELECT list(tok ORDER BY df DESC, tok) AS ks FROM top)
SELECT doc_id, array_to_string({S.drop_stop(S.split_tokens(_TRANSLATED), 'ks[1:20]')}, ' ') AS clean FROM documents, keys"""),
    "similar_by_id": (similar_by_id, "WITH seeds AS (SELECT min(vec_id) AS seed_id FROM embeddings),\n"
                      + E._embedding_topk_sql(TP.APP_TOPK) + "\nSELECT seed_id, item_id, similarity, rank FROM eranked"),
    "recommend_named": (recommend_named, f"""SELECT CAST(t.seed_id AS INTEGER) AS "userId", CAST(t.item_id AS INTEGER) AS "itemId",
       t.similarity AS score, t.rank, p.p_name AS name FROM ({indexplans.DOT_SQL}) t LEFT JOIN part p ON p.p_partkey = t.item_id"""),
}
