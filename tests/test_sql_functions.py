from pyspark.sql import functions as F

from credo.functions import (binary_label, confidence_pct, cs_weight, decide, length_bucket, norm_affil,
                             norm_context, norm_speaker, normalize_label, standardize_format)
from credo.functions.sql import register_sql_functions
from credo.plans.fixtures import register_fixture_views
from tests.conftest import SF0001, rows


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    register_fixture_views(spark, SF0001)
    sql = spark.sql("""SELECT row_key, credo_norm_speaker(speaker_name) a, credo_norm_context(statement_context) b,
        credo_norm_affil(speaker_affiliation) c, credo_clean(statement) d, credo_binary_label(credo_norm_label(label)) e,
        credo_cs_weight(credo_norm_label(label)) f FROM f1""")
    f1 = spark.table("f1")
    df = f1.select("row_key", norm_speaker("speaker_name").alias("a"), norm_context("statement_context").alias("b"),
                   norm_affil("speaker_affiliation").alias("c"), standardize_format("statement").alias("d"),
                   binary_label(normalize_label("label")).alias("e"), cs_weight(normalize_label("label")).alias("f"))
    assert rows(sql) == rows(df)
    s3 = spark.sql("SELECT row_key, credo_decide(prob, 0.57D) p, credo_confidence(prob, credo_decide(prob, 0.57D)) c, "
                   "credo_length_bucket(len_norm) l FROM f3")
    f3 = spark.table("f3")
    d3 = f3.select("row_key", decide("prob", 0.57).alias("p"), confidence_pct("prob", decide("prob", 0.57)).alias("c"),
                   length_bucket("len_norm").alias("l"))
    assert rows(s3) == rows(d3)
