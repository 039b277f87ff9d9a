import os

import pytest
from pyspark.sql import functions as F

from recolens.functions import columns as C
from recolens.operators import corpus, ids
from recolens.sources import files


def test_dense_ids_follow_key_order(spark):
    keys = [f"user{(i * 37) % 101:03d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "name string").repartition(5)
    got = {r["name"]: r["dense_id"] for r in ids.dense_ids(df, "name").collect()}
    want = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert got == want


def test_column_roles(spark):
    assert C.label_key(" Hotel ID ") == "hotel_id" and C.label_key("--") == ""
    roles = [C.Role("Hotel_ID", ("hotelid",), required=True), C.Role("Hotel_Name", ("hotel_name", "name")),
             C.Role("text", ("description",), place=2)]
    df = spark.createDataFrame([(1, "a", "b")], [" Hotel ID ", "name", "about"])
    assert C.with_role_names(df, roles).columns == ["Hotel_ID", "Hotel_Name", "text"]
    with pytest.raises(ValueError, match="several columns"):
        C.resolve_roles(["Hotel ID", "name", "hotel_id"], roles)
    with pytest.raises(ValueError, match="required role Hotel_ID"):
        C.resolve_roles(["name", "about"], roles)
    assert C.resolve_roles(["hotelid"], roles) == {"Hotel_ID": "hotelid"}
    assert C.resolve_roles(["Hotel_ID", "name", "Name 2"], roles)["text"] == "Name 2"
    assert C.trim_columns(spark.createDataFrame([(1,)], [" x "])).columns == ["x"]
    with pytest.raises(ValueError):
        C.require_columns(df, ["Reviewer_Name"])


def test_missing_label_and_fallbacks(spark):
    df = spark.createDataFrame([("No information",), ("N/A",), ("4 stars",), (None,)], "v string")
    got = [r["d"] for r in df.select(C.missing_label(F.col("v")).alias("d")).collect()]
    assert got == [C.MISSING_LABEL, C.MISSING_LABEL, "4 stars", C.MISSING_LABEL]
    cat = spark.createDataFrame([("h", "addr")], "Hotel_Name string, Hotel_Address string")
    out = C.score_fallback(C.with_joined_default(cat, "Hotel_Description", ("Hotel_Name", "Hotel_Address"))).first()
    assert out["Hotel_Description"] == "h addr" and 7.5 <= out["Total_Score"] <= 9.8


def test_review_bag_and_corpus(spark):
    rv = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, ""), (2, 0, "x"), (None, 0, "z")],
                               "item_id long, seg_order long, text string")
    bags = {r["item_id"]: r["bag"] for r in corpus.review_bag(rv).collect()}
    assert bags == {1: "a  c", 2: "x"}
    cat = spark.createDataFrame([(1, "t1"), (3, "t3")], "item_id long, text string")
    c = {r["item_id"]: r["corpus"] for r in
         corpus.corpus(cat, corpus.review_bag(rv), F.col("text")).collect()}
    assert c == {1: "t1 a  c", 3: "t3 "}
    prof = corpus.length_profile(cat, "text").first()
    assert prof["count"] == 2 and prof["p50"] == 2.0


def test_csv_encoding_fallback_and_bom(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "latin.csv")
    with open(p1, "wb") as f:
        f.write("Hotel_ID,Hotel_Name\n1,Café Ngô\n".encode("latin-1"))
    df = files.read_csv_safely(spark, p1)
    assert df.first()["Hotel_Name"] == "Café Ngô"
    p2 = os.path.join(tmp_dir, "bom.csv")
    with open(p2, "wb") as f:
        f.write("\ufeffHotel_ID,Hotel_Name\n1,\"Khách sạn\nA\"\n".encode("utf-8"))
    df2 = files.read_csv_safely(spark, p2)
    assert df2.columns == ["Hotel_ID", "Hotel_Name"]
    assert df2.first()["Hotel_Name"] == "Khách sạn\nA"


def test_tables_io(spark, tmp_dir):
    assert files.read_recommendations(spark, f"{tmp_dir}/none.csv").columns == ["UserName", "RecommendedHotel"]
    assert files.load_embeddings(spark, f"{tmp_dir}/none") is None
    e = spark.createDataFrame([(1, [0.5, 1.0])], "item_id long, embedding array<double>")
    files.save_embeddings(e, f"{tmp_dir}/emb")
    back = files.load_embeddings(spark, f"{tmp_dir}/emb").first()
    assert back["item_id"] == 1 and back["embedding"] == [0.5, 1.0]
    files.write_table(e.select("item_id"), f"{tmp_dir}/out", fmt="csv", single_file=True)
    assert spark.read.option("header", "true").csv(f"{tmp_dir}/out").count() == 1
    prof = files.profile(e).first()
    assert prof["n_rows"] == 1 and prof["n_cols"] == 2
    assert len(files.run_stamp()) == 15


def test_encode_texts_batches(spark):
    from recolens.operators.encoders import encode_texts

    def toy_encoder():
        import zlib

        import numpy as np

        def enc(texts):
            out = np.zeros((len(texts), 8), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in t.split():
                    out[i, zlib.crc32(w.encode()) % 8] += 1.0
            return out
        return enc

    df = spark.createDataFrame([(i, f"w{i % 3} common") for i in range(40)], "item_id long, text string")
    out = encode_texts(df.repartition(3), toy_encoder, batch_size=7).collect()
    assert len(out) == 40 and all(len(r["embedding"]) == 8 for r in out)
    assert all(sum(r["embedding"]) == 2.0 for r in out)


def test_align_key_type_and_membership(spark):
    recs = spark.createDataFrame([("1", 0.5), ("x", 0.2)], "itemId string, score double")
    cat = spark.createDataFrame([(1, "a")], "item_id bigint, name string")
    out = C.align_key_type(recs, "itemId", cat, "item_id")
    assert dict(out.dtypes)["itemId"] == "bigint"
    joined = out.join(cat, out.itemId == cat.item_id, "left").orderBy("score").collect()
    assert [r["name"] for r in joined] == [None, "a"]
    from recolens.plans import serve
    assert serve.seed_by_id(cat, 1).first()["seed_id"] == 1
    with pytest.raises(ValueError):
        serve.seed_by_id(cat, 99)


def test_serve_search_and_similar(spark):
    from recolens.plans import serve
    cat = spark.createDataFrame(
        [(1, "h1", "quiet room near beach pool"), (2, "h2", "pool and beach bar"),
         (3, "h3", "city centre quiet room"), (4, "h2", "mountain view")],
        "item_id long, name string, text string")
    idx = serve.build_index(cat, min_df=1)
    top = [r["item_id"] for r in serve.search(idx, "Beach POOL!", 2).collect()]
    assert top[0] in (1, 2) and set(top) == {1, 2}
    sim = serve.similar(idx, "h2", 3).collect()       # first item named h2 is id 2
    assert all(r["item_id"] != 2 for r in sim) and sim[0]["item_id"] == 1
    recs = spark.createDataFrame([("u", "h2"), ("v", "h1")], "UserName string, RecommendedHotel string")
    assert sorted(r["item_id"] for r in serve.recommend(recs, cat, "u").collect()) == [2, 4]


def test_size_for_input(spark):
    from recolens.session import size_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        kept = size_for_input(spark, 100 << 40)            # explicit session value kept
        assert "spark.sql.shuffle.partitions" not in kept
        applied = size_for_input(spark, 100 << 40, override=True)   # 100 TiB
        assert int(applied["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
        assert applied["spark.sql.files.maxPartitionBytes"] == str(128 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_review_bag_two_level_equals_single_pass(spark):
    import random
    rnd = random.Random(3)
    rows = [(i % 3, o, f"w{o}" if rnd.random() > 0.1 else "") for i, o in
            enumerate(rnd.sample(range(5000), 700))]
    rv = spark.createDataFrame(rows, "item_id long, seg_order long, text string")
    got = {r["item_id"]: r["bag"] for r in corpus.review_bag(rv, chunk_rows=37).collect()}
    want = {}
    for it in {r[0] for r in rows}:
        want[it] = " ".join(t for _, o, t in sorted((r for r in rows if r[0] == it), key=lambda r: r[1]))
    assert got == want


def test_dense_ids_first_appearance(spark):
    rows = [(i, f"u{(i * 7) % 23}") for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(rows, "pos long, name string").repartition(4)
    got = {r["name"]: r["dense_id"] for r in ids.dense_ids(df, "name", order_col="pos").collect()}
    seen = []
    for _, n in sorted(rows):
        if n is not None and n not in seen:
            seen.append(n)
    assert got == {n: i for i, n in enumerate(seen)}


def test_similar_with_embeddings_and_head(spark):
    from recolens.plans import serve
    from recolens.sources.files import head
    cat = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x z"), (3, "c", "q r")],
                                "item_id long, name string, text string")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])],
                                "item_id long, embedding array<double>")
    idx = serve.build_index(cat, min_df=1)
    got = [r.item_id for r in serve.similar(idx, "a", 2, embeddings=emb).collect()]
    assert got == [3, 2]
    assert head(cat, 2).count() == 2
