from pyspark.sql import functions as F

from credo.operators.explain import evidence_lines, rule_based_explanation

COLS = ("row_key string, cs_known boolean, cs_val double, spk_cred double, afl_cred double, ctx_cred double, "
        "len_norm double, a_cs_ratio double, a_speaker_cred double, a_affil_cred double, a_ctx_cred double, "
        "a_len_norm double")


def test_skip_rules_before_limit_and_zero_is_false(spark):
    df = spark.createDataFrame([("r", False, 0.3125, 0.56, 0.625, 0.4, 1.5, 0.9, 0.8, 0.0, -0.1, 0.1)], COLS)
    out = [(r["rank"], r["feature"], r["line"]) for r in evidence_lines(df, 0.55).orderBy("rank").collect()]
    # cs_ratio skipped (unknown speaker), speaker_cred skipped (within 0.02 of default)
    assert out == [
        (1, "ctx_cred", "statements made in this context are true 40% of the time (supports FALSE)"),
        (2, "len_norm", "the statement is unusually long (supports TRUE)"),
        (3, "affil_cred", "this speaker's political affiliation has a 62% truthfulness rate (supports FALSE)"),
    ]


def test_cs_line_rounds_half_even(spark):
    df = spark.createDataFrame([("r", True, 0.3125, 0.9, 0.5, 0.5, 0.0, 0.9, 0.0, 0.0, 0.0, 0.0)], COLS)
    line = evidence_lines(df, 0.55).filter("rank = 1").first()["line"]
    assert line == "the speaker's falsehood score is 0.31/1.0 (supports TRUE)"


def test_rule_based_text(spark):
    df = spark.createDataFrame([("TRUE", 62, "tax, rate, low", "this speaker has been truthful 30% of the time "
                                 "historically (supports FALSE)"), ("FALSE", 70, "", None)],
                               "l string, c int, w string, e string")
    out = [r[0] for r in df.select(rule_based_explanation(F.col("l"), F.col("c"), F.col("w"), F.col("e"))).collect()]
    assert out == [
        "This statement is likely true (confidence: 62%). The words most associated with this decision were: "
        "tax, rate, low. This speaker has been truthful 30% of the time historically (supports FALSE).",
        "This statement is likely false (confidence: 70%).",
    ]
