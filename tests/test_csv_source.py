"""The reference's input shape end to end: catalog + review CSVs with
synonym / padded column names, string hotel ids, dirty scores, dictionaries."""

import csv
import os
import random

from recolens.plans import csv_source as CS


def _write_fixture(d):
    rnd = random.Random(4)
    words = ["phòng", "sạch", "đẹp", "view", "biển", "nhân", "viên", "thân", "thiện", "ks", "ok", "gần",
             "chợ", "ăn", "sáng", "ngon", "hồ", "bơi", "yên", "tĩnh"]
    with open(os.path.join(d, "hotel_info.csv"), "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow([" Hotel ID ", "name", "Hotel_Address", "description"])
        for h in range(30):
            w.writerow([f"H{h:03d}", f"Khách sạn {h % 12}", f"{h} Trần Phú",
                        " ".join(rnd.choice(words) for _ in range(12))])
    scores = ["8,5", "9.2", "N/A", "10", "7.75 điểm", "", "abc"]
    with open(os.path.join(d, "hotel_comments.csv"), "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["Hotel ID", "Reviewer Name", "Score", "Body"])
        for u in range(25):
            for h in rnd.sample(range(30), 6):
                w.writerow([f"H{h:03d}", f"user {u}", rnd.choice(scores),
                            " ".join(rnd.choice(words) for _ in range(8)) + " 👍"])
        w.writerow(["H001", "", "9", "no reviewer"])
    dd = os.path.join(d, "dict")
    os.makedirs(dd)
    with open(os.path.join(dd, "teencode.txt"), "w", encoding="utf-8") as f:
        f.write("ks\tkhách sạn\nok\tổn\n")
    with open(os.path.join(dd, "emojicon.txt"), "w", encoding="utf-8") as f:
        f.write("👍\tthích\r\n")
    with open(os.path.join(dd, "vietnamese-stopwords.txt"), "w", encoding="utf-8") as f:
        f.write("gần\nvà\na_lô\n")
    return dd


def test_load_review_tables(spark, tmp_dir):
    _write_fixture(tmp_dir)
    t = CS.load_review_tables(spark, f"{tmp_dir}/hotel_info.csv", f"{tmp_dir}/hotel_comments.csv")
    cat = {r["item_key"]: r["item_id"] for r in t.catalog.collect()}
    assert cat["H000"] == 0 and cat["H029"] == 29 and len(cat) == 30   # first-appearance ids
    assert t.interactions.count() == 150                                 # null reviewer dropped
    one = t.reviews.orderBy("seg_order").first()["merged"]
    assert one.startswith("H") and "user 0" in one and "👍" in one     # all string columns
    r = CS.ratings(t)
    assert r.count() < 150 and r.agg({"rating": "max"}).first()[0] <= 10.0


def test_run_end_to_end(spark, tmp_dir):
    dd = _write_fixture(tmp_dir)
    paths = CS.run(spark, f"{tmp_dir}/hotel_info.csv", f"{tmp_dir}/hotel_comments.csv",
                   f"{tmp_dir}/out", dict_dir=dd, methods=("tfidf", "embedding", "word2vec"),
                   grid={"rank": [3], "regParam": [0.1], "maxIter": [3]}, stamp="20260101_000000")
    s = spark.read.option("header", "true").csv(paths["eval_summary"]).collect()
    # no embedding table given: that method is skipped
    assert sorted({r["method"] for r in s}) == ["tfidf", "word2vec"] and len(s) == 6
    assert all(0.0 <= float(r["precision"]) <= 1.0 for r in s)
    assert spark.read.option("header", "true").csv(paths["als_trials"]).count() == 1
