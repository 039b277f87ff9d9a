from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators import lexicon as L
from recolens.sources.dictionaries import read_dict


def test_read_dict_last_wins_and_blank_lines(spark, tmp_dir):
    p = f"{tmp_dir}/teen.txt"
    with open(p, "w", encoding="utf-8") as f:
        f.write("ntn\tnhư thế này\n\n  ko \t không \nntn\tnhư thế nào\nonly_key\nhi there\txin chào\n")
    d = {r["key"]: r["value"] for r in read_dict(spark, p).collect()}
    assert d["ntn"] == "như thế nào"          # later line wins
    assert d["ko"] == "không"                  # trimmed
    assert d["only_key"] == ""                 # no separator
    assert d["hi there"] == "xin chào"        # key with a space is kept (never matches a token)
    assert read_dict(spark, f"{tmp_dir}/absent.txt").count() == 0


def test_plain_word_list(spark, tmp_dir):
    p = f"{tmp_dir}/stop.txt"
    with open(p, "w", encoding="utf-8") as f:
        f.write("a_lô\nai\nai\n\n")
    assert sorted(r["key"] for r in read_dict(spark, p, sep=None).collect()) == sorted(["ai", "a_lô"])


def test_token_map_semantics(spark):
    m = {"ks": "khách sạn", "hi there": "xin chào", "ko": "không"}
    df = spark.createDataFrame([(1, "ks ok hi there ko")], "id int, t string")
    out = df.select(T.join_tokens(L.map_tokens(T.split_tokens(F.col("t")), m)).alias("o")).first()["o"]
    assert out == "khách sạn ok hi there không"


def test_inline_and_join_forms_agree(spark):
    m = {"a": "x y", "b": "z", "c": "q"}
    stop = ["z", "q"]
    rows = [(1, "a b c a"), (2, "q q r"), (3, ""), (4, "b")]
    df = spark.createDataFrame(rows, "id long, t string").select(
        "id", T.split_tokens(F.col("t")).alias("toks"))
    inline = {r["id"]: r["o"] for r in df.select(
        "id", L.drop_tokens(L.map_tokens(F.col("toks"), m), stop).alias("o")).collect()}
    dm = spark.createDataFrame(list(m.items()), "key string, value string")
    ds = spark.createDataFrame([(s,) for s in stop], "key string")
    j = L.drop_tokens_join(L.map_tokens_join(df, "id", "toks", dm), "id", "toks", ds)
    joined = {r["id"]: r["toks"] for r in j.collect()}
    for i, t in rows:
        exp = [m.get(x, x) for x in t.split() if m.get(x, x) not in stop]
        assert inline[i] == exp, i
        assert joined[i] == exp, i


def test_inset_used_for_large_sets(spark):
    words = [f"w{i}" for i in range(500)]
    df = spark.createDataFrame([("w1 keep w499",)], "t string")
    q = df.select(T.join_tokens(L.drop_tokens(T.split_tokens(F.col("t")), words)).alias("o"))
    assert q.first()["o"] == "keep"
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() or "inset" in plan


def test_crlf_dictionary(spark, tmp_dir):
    p = f"{tmp_dir}/emo.txt"
    with open(p, "wb") as f:
        f.write("❤\tyêu\r\n👍\tthích\r\n\r\n".encode("utf-8"))
    d = {r["key"]: r["value"] for r in read_dict(spark, p).collect()}
    assert d == {"❤": "yêu", "👍": "thích"}


def _greedy_compounds(tokens, compounds):
    seqs = sorted((c.split("_") for c in compounds if "_" in c), key=len, reverse=True)
    out, i = [], 0
    while i < len(tokens):
        for s in seqs:
            if tokens[i:i + len(s)] == s:
                i += len(s)
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_compound_stopwords_greedy_longest(spark):
    import random
    compounds = ["a_lô", "ai_ai", "ai_ai_ai", "ai_nấy", "bị_vì", "b.c_d", "x_y_z"]
    vocab = ["a", "lô", "ai", "nấy", "bị", "vì", "aiz", "b.c", "d", "x", "y", "z", "q"]
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14)))) for i in range(200)]
    rows.append((999, "ai ai ai nấy a lô ai aiz x"))
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["o"] for r in df.select("id", L.drop_compounds(F.col("t"), compounds).alias("o")).collect()}
    for i, t in rows:
        assert got[i] == " ".join(_greedy_compounds(t.split(), compounds)), t
    assert got[999] == "nấy ai aiz x"


def test_collect_bounded_dictionaries(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, value string")
    assert L.collect_map(d) == {"a": "x", "b": "y"}
    assert L.collect_map(d, max_entries=1) is None          # past the bound: use the join form
    assert L.collect_set(d) == ["a", "b"]


def test_replace_substrings_order(spark):
    df = spark.createDataFrame([("x:)) y",)], "t string")
    m = {":)": "smile", ":))": "laugh"}
    a = df.select(L.replace_substrings(F.col("t"), m).alias("o")).first()["o"]
    b = df.select(L.replace_substrings(F.col("t"), m, longest_first=True).alias("o")).first()["o"]
    assert a == "x smile ) y" and b == "x laugh  y"
