from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credo.operators.split import split_stratified
from credo.plans.chain import labelled
from credo.plans import fixtures as fx
from tests.conftest import SF0001, rows


def test_stratified_equals_plain_window(spark):
    lab = labelled(fx.f2(spark, SF0001))
    got = split_stratified(lab).select("row_key", "y", "split")
    sizes = {r["y"]: r for r in got.groupBy("y").agg(
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v")).collect()}
    w = Window.partitionBy("y").orderBy(F.md5("row_key"), "row_key")
    ranked = lab.withColumn("rk", F.row_number().over(w)).select("row_key", "y", "rk").collect()
    expect = []
    for r in ranked:
        s = sizes[r["y"]]
        split = "test" if r["rk"] <= s["t"] else "val" if r["rk"] <= s["t"] + s["v"] else "train"
        expect.append((r["row_key"], r["y"], split))
    assert rows(got) == sorted(expect)
    n = lab.count()
    total_test = sum(s["t"] for s in sizes.values())
    import math
    assert total_test == math.ceil(0.1 * n)


def test_same_result_for_one_and_many_partitions(spark):
    lab = labelled(fx.f2(spark, SF0001))
    a = rows(split_stratified(lab).select("row_key", "split"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = rows(split_stratified(lab).select("row_key", "split"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_null_class_keeps_its_rows(spark):
    from credo.operators.split import split_stratified

    rows_ = [(f"k{i}", None if i % 5 == 0 else i % 2) for i in range(200)]
    out = split_stratified(spark.createDataFrame(rows_, "row_key string, y int")).groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in out}
    assert sum(got.values()) == 200
    assert sum(n for (y, _), n in got.items() if y is None) == 40
    assert {s for y, s in got if y is None} == {"train", "val", "test"}
