from pyspark.sql import functions as F

from credo.operators.dedup import dedup_report, deduplicate
from tests.conftest import rows

SCHEMA = "row_key string, statement string, label string, speaker_name string"


def test_edge_cases(spark):
    df = spark.createDataFrame([
        ("1", "a", "true", "s"), ("2", "a", None, "s"),          # both survive
        ("3", "b", "true", "s"), ("4", "b", "foo", "s"),          # both dropped
        ("5", None, "true", "s"), ("6", None, "false", "s"),      # NULL statement: kept
        ("8", "c", "true", "x"), ("7", "c", "true", "y"),         # one row: smallest key
    ], SCHEMA)
    out = rows(deduplicate(df), "row_key", "statement", "label", "speaker_name")
    assert out == [("1", "a", "true", "s"), ("2", "a", None, "s"), ("5", None, "true", "s"),
                   ("6", None, "false", "s"), ("7", "c", "true", "y")]
    r = dedup_report(df).first()
    assert (r["n_before"], r["n_after_a"], r["n_after_b"]) == (8, 7, 5)


def test_idempotent_and_no_contradictions(spark):
    from credo.plans import fixtures as fx
    from tests.conftest import SF0001
    from credo.functions.labels import normalize_label

    f2 = fx.f2(spark, SF0001).withColumn("label", normalize_label("label"))
    once = deduplicate(f2)
    assert once.count() == 3505
    assert deduplicate(once).count() == once.count()
    multi = once.filter(F.col("statement").isNotNull()).groupBy("statement").agg(
        F.countDistinct("label").alias("k")).filter("k > 1")
    assert multi.count() == 0


def test_hot_statement(spark):
    # one statement holding most rows is pre-aggregated, result unchanged
    data = [(f"k{i:05d}", "hot", "true", "s") for i in range(3000)] + [("z", "cold", "false", "s")]
    out = rows(deduplicate(spark.createDataFrame(data, SCHEMA)), "row_key")
    assert out == [("k00000",), ("z",)]
