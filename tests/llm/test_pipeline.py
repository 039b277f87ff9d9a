"""The pipeline's stages on a small corpus with planted cases, and the entry."""

import random

import corpus_pipeline
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def test_stages_take_effect(spark, tmp_dir):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(200):
        text = prose(rng, 50)
        if i % 5 == 1:
            text += " nastyfool " + prose(rng, 5) + " nastyrat"
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, 1, int(i % 5 == 1)))
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    for i in range(300, 340):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i > 300 else secret
        rows.append((i, f'{prose(rng, 20)} 4734663219866878 x token = "{value}" {prose(rng, 5)}', "en", "src", 0))
    near = rows[0][1].split()
    near[7] = "other"
    half = "\n".join([rows[2][1], prose(rng, 60)])
    rows += [(400, " ".join(near) + "\n" + prose(rng, 3), "en", "s", 0), (401, half, "en", "s", 0), (402, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tmp_dir)
        path = f"{tmp_dir}/{name}"
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        seen[name] = docs
    texts = {n: {r.doc_id: r.text for r in d.collect()} for n, d in seen.items() if n != "packing"}
    assert set(texts["toxicity"]) == {r[0] for r in rows} - set(range(1, 200, 5))
    assert texts["line_dedup"][401] == half.split("\n")[1] and texts["line_dedup"][0] == rows[0][1]
    assert set(texts["near_duplicates"]) <= set(texts["line_dedup"]) and 0 in texts["near_duplicates"]
    assert secret not in texts["secrets"][300] and "[SECRET]" in texts["secrets"][300]
    assert "4734663219866878" in texts["secrets"][300]
    pieces = seen["packing"].groupBy("sequence_id").sum("length").collect()
    assert pieces and all(r[1] <= 1024 for r in pieces)
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == set(texts["secrets"])


def test_near_duplicates_keeps_one_row_of_each_class(spark, tmp_dir):
    rng = random.Random(22)
    a, b, c, d, alone = (prose(rng, 60) for _ in range(5))
    near = a.replace(a.split()[9], "other", 1)
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "fr"), (None, a, "en"), (2, near, "en"), (2, alone, "en"),
            (None, b, "en"), (None, b, "en"), (None, c, "en"), (7, c, "en"), (8, d, "en"), (9, "", "en"), (10, None, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, frame, tmp_dir).collect()]
    want = [(1, a), (2, alone), (None, b), (7, c), (8, d), (9, ""), (10, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(entry.oracle_sql()) <= set(names)
