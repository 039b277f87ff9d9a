import os

from recolens.operators.lexicon import Lexicons
from recolens.streaming.reviews import clean_review_stream, cleaned


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    rows1 = [(1, "Phòng SẠCH, đẹp!!! 10/10", "8,5"), (2, "ks ok", "N/A")]
    rows2 = [(3, "Xem www.x.vn ngay", "9")]
    schema = "id long, text string, score string"
    spark.createDataFrame(rows1, schema).write.mode("append").parquet(src)
    lex = Lexicons(teencode={"ks": "khách sạn"})
    q = clean_review_stream(spark, src, spark.createDataFrame([], schema).schema,
                            os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"),
                            "text", "score", lex)
    q.awaitTermination(120)
    spark.createDataFrame(rows2, schema).write.mode("append").parquet(src)
    q = clean_review_stream(spark, src, spark.createDataFrame([], schema).schema,
                            os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"),
                            "text", "score", lex)
    q.awaitTermination(120)
    got = {r["id"]: (r["clean_text"], r["rating_clean"])
           for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    batch = cleaned(spark.createDataFrame(rows1 + rows2, schema), "text", "score", lex)
    want = {r["id"]: (r["clean_text"], r["rating_clean"]) for r in batch.collect()}
    assert got == want and len(got) == 3
    assert want[2][0] == "khách sạn ok" and want[1][1] == 8.5
