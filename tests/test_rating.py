from pyspark.sql import functions as F

from recolens.functions.rating import normalize_rating, unparsed

RATINGS_RAW = [
    ("8,5", 8.5), ("8.75 x", 8.75), ("1.000", 1.0), ("1234", 10.0), ("-5", 5.0),
    ("10/10", 10.0), ("N/A", None), ("abc", None), ("", None), (None, None),
    ("  9.2  ", 9.2), ("nan", None), ("na", None), ("None", None), ("0", 0.0), ("7", 7.0),
]


def test_normalize_rating(spark):
    df = spark.createDataFrame([(r,) for r, _ in RATINGS_RAW], "raw string")
    got = [r["v"] for r in df.select(normalize_rating(F.col("raw")).alias("v")).collect()]
    for (raw, exp), g in zip(RATINGS_RAW, got):
        if exp is None:
            assert g is None, raw
        else:
            assert abs(g - exp) < 1e-12, raw


def test_unparsed_predicate(spark):
    df = spark.createDataFrame([(r,) for r, _ in RATINGS_RAW], "raw string")
    bad = {r["raw"] for r in df.select("raw", normalize_rating(F.col("raw")).alias("v"))
           .where(unparsed(F.col("raw"), F.col("v"))).collect()}
    assert bad == {"N/A", "abc", "", "nan", "na", "None"}


def test_a_score_is_parsed_once_a_row(spark):
    """Dropping null ratings must not repeat the parsing in every place that uses its value."""
    from recolens.operators import factor
    df = spark.createDataFrame([(1, 2, " 8,4 "), (1, 3, "N/A"), (2, 2, "12.5/10"), (2, 3, None), (3, 1, "nine"), (3, 2, "")],
                               "u int, i int, raw string").withColumn("score", F.concat("raw", F.lit("")))
    r = factor.ratings_frame(df.withColumn("r", normalize_rating(F.col("score"))), "u", "i", "r")
    assert sorted(tuple(x) for x in r.collect()) == [(1, 2, 8.4), (2, 2, 10.0)]
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 2
