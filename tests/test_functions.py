import pytest
from pyspark.sql import functions as F

from credo.functions import (binary_label, confidence_pct, cs_weight, decide, length_bucket, norm_affil,
                             norm_context, norm_speaker, standardize_format, statement_length, word_tokens)


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("raw", ["Barack Obama", "barack obama", "barack-obama", "  Barack \t Obama "])
def test_norm_speaker_golden(spark, raw):
    assert one(spark, norm_speaker("v"), raw) == "barack-obama"


def test_norm_speaker_empty_and_null(spark):
    assert one(spark, norm_speaker("v"), "") == ""
    assert one(spark, norm_speaker("v"), "   ") == ""
    assert one(spark, norm_speaker("v"), None) is None


@pytest.mark.parametrize("raw,out", [("A Chain Email", "a chain email"), ("a chain email", "a chain email"),
                                     ("Press Release", "press release"), (" Press Release\x1c", "press release")])
def test_norm_context_golden(spark, raw, out):
    assert one(spark, norm_context("v"), raw) == out


@pytest.mark.parametrize("raw,out", [("Democrat", "democrat"), ("Republican", "republican")])
def test_norm_affil_golden(spark, raw, out):
    assert one(spark, norm_affil("v"), raw) == out


@pytest.mark.parametrize("raw,out", [
    (None, ""),
    ("Taxes “increased” by 30%", "Taxes increased by 30%"),
    ("see https://x.y/z now", "see now"),
    ("abchttp://q.r tail", "abc tail"),
    ("ends with http", "ends with http"),
    ("a\x1c\x1d b\t\n c  ", "a b c"),
    ("été", "t"),
])
def test_standardize_format(spark, raw, out):
    assert one(spark, standardize_format("v"), raw) == out


def test_statement_length_counts_code_points(spark):
    assert one(spark, statement_length("v"), "héllo") == 5
    assert one(spark, statement_length("v"), None) == 0


def test_word_tokens_empty_text(spark):
    assert one(spark, word_tokens("v"), "   ") == []
    assert one(spark, word_tokens("v"), "Hello  World") == ["hello", "world"]
    assert one(spark, word_tokens("v"), "It's 30% (really)!") == ["it", "'", "s", "30", "%", "(", "really", ")", "!"]


@pytest.mark.parametrize("label,y,w", [("true", 1, 0.0), ("mostly-true", 1, 0.2), ("half-true", 1, 0.5),
                                       ("barely-true", 0, 0.75), ("false", 0, 0.9), ("extremely-false", 0, 1.0),
                                       ("pants-fire", None, 0.5), (None, None, 0.5)])
def test_labels(spark, label, y, w):
    assert one(spark, binary_label("v"), label) == y
    assert one(spark, cs_weight("v"), label) == pytest.approx(w)


def test_decide_inclusive_and_confidence_half_even(spark):
    df = spark.createDataFrame([(0.57,), (0.5699999,), (0.625,), (0.375,)], "p double")
    out = df.select(decide("p", 0.57).alias("d"), "p").collect()
    assert [r["d"] for r in out] == ["TRUE", "FALSE", "TRUE", "FALSE"]
    c = df.select(confidence_pct("p", decide("p", 0.5)).alias("c")).collect()
    # 62.5 -> 62 (half to even), 1 - 0.375 = 0.625 -> 62
    assert [r["c"] for r in c][2:] == [62, 62]


def test_length_bucket(spark):
    df = spark.createDataFrame([(1.5,), (1.0,), (-1.0,), (-1.01,)], "z double")
    assert [r[0] for r in df.select(length_bucket("z")).collect()] == [
        "unusually long", "typical length", "typical length", "unusually short"]


def test_strip_ws_is_pythons_strip_without_a_regular_expression(spark):
    from credo.functions.text import strip_ws

    texts = [None, "", "\t \x1c", *(f"{chr(i)}a{chr(i)} b{chr(i)}{chr(i)}" for i in range(0x3100) if not 0xD800 <= i < 0xE000)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_ws("t").alias("s"))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in out.collect())
