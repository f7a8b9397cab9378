from pyspark.sql import functions as F

from vitalshare.functions import (
    decimal_comma,
    in_list,
    left_join,
    not_in_list,
    pad3,
    recode,
    share,
    stable_round,
    standardise_age,
    strict_total,
    total,
)


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_pad_never_truncates(spark):
    assert column(spark, ["5", "12345", None], pad3("v")) == ["005", "12345", None]


def test_age_text(spark):
    texts = ["0 A 6 DIAS", "7 A 27 DIAS", "28 A 364 DIAS", "MENOR 1 ANO IGN", "1 ANO"]
    texts += ["4 ANOS", "89 ANOS", "90 ANOS", "104 ANOS", "7 MES", "texto", None]
    assert column(spark, texts, standardise_age("v")) == [
        "Early Neonatal", "Late Neonatal", "Post Neonatal", "Post Neonatal", "0",
        "0", "85", "90", "90", None, "texto", None,
    ]


def test_decimal_comma_and_bad_numbers(spark):
    assert column(spark, ["1,5", "12", "x", "1,2,3"], decimal_comma("v")) == [1.5, 12.0, None, None]


def test_membership_is_never_null(spark):
    assert column(spark, ["a", "b", None], in_list("v", ["a"])) == [True, False, False]
    assert column(spark, ["a", "b", None], not_in_list("v", ["a"])) == [False, True, True]


def test_recode_passes_others(spark):
    assert column(spark, ["1", "7", None], recode("v", {"1": "one"})) == ["one", "7", None]


def test_share_of_zero_total_is_null(spark):
    assert column(spark, [1.0, None], share("v", F.lit(0.0)), "double") == [None, None]


def test_totals(spark):
    rows = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, v double"
    )
    got = {
        r.k: (r.t, r.s)
        for r in rows.groupBy("k").agg(total("v").alias("t"), strict_total("v").alias("s")).collect()
    }
    assert got == {"a": (1.0, None), "b": (2.0, 2.0), "c": (0.0, None)}


def test_null_keys_join(spark):
    left = spark.createDataFrame([("a", None), (None, None)], "k string, m string")
    right = spark.createDataFrame([("a", None, 1), (None, None, 2)], "k string, m string, x int")
    assert sorted(r.x for r in left_join(left, right, ["k", "m"]).collect()) == [1, 2]


def test_rounding_of_exact_ties(spark):
    # 2 ** -7 is a tie at six digits; a hair below it must publish the same value.
    values = [2.0**-7, 2.0**-7 - 1e-17]
    assert len(set(column(spark, values, stable_round("v"), "double"))) == 1
