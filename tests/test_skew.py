"""Hot keys: joins that keep them out of one task, with adaptive execution off."""

import statistics
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from credo.operators.features import feature_table, find_hot, trained_hot
from credo.operators.lookups import all_lookups, lookup_stats
from credo.operators.skew import heavy_hitters, hot_values, split_join
from credo.plans.chain import Chain
from tests.conftest import SF0001, rows


@contextmanager
def plain_shuffles(spark):
    """No adaptive execution and no broadcast by size: only what the plan itself says."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def task_sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def skewed(spark, n=20_000):
    """A third of the rows on one key, a tenth on none, the rest on many."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 10 == 1, None).otherwise(F.concat(F.lit("k"), (i % 4001).cast("string")))
    return spark.range(n).select(i.alias("row_key"), key.alias("key"))


def test_heavy_hitters_are_the_frequent_keys(spark):
    df = skewed(spark)
    assert len(heavy_hitters(df, ["key"])) == 1
    assert hot_values(df, {"a": F.col("key"), "b": F.lit(None).cast("string")}) == {"a": ["hot"], "b": []}
    assert heavy_hitters(df.limit(0), ["key"]) == [] and hot_values(df.limit(0), {"a": F.col("key")}) == {"a": []}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_split_join_gives_the_plain_joins_rows(spark, how):
    df = skewed(spark, 3000)
    table = df.select("key").distinct().filter("key is not null and key <> 'k7'").withColumn("value", F.length("key"))
    assert rows(split_join(df, table, ["key"], how)) == rows(df.join(table, "key", how).select(*split_join(df, table, ["key"], how).columns))
    with pytest.raises(ValueError):
        split_join(df, table, ["key"], "full")


def test_split_join_keeps_tasks_even(spark):
    df = skewed(spark).repartition(16, "row_key")
    table = df.select("key").distinct().filter("key is not null").withColumn("value", F.length("key"))
    with plain_shuffles(spark):
        sizes = task_sizes(split_join(df, table, ["key"], "inner"))
        assert max(sizes) <= 3 * statistics.median(sizes), sizes
        assert max(task_sizes(df.join(table, "key"))) > 3 * statistics.median(sizes)


def test_features_of_a_hot_speaker_keep_tasks_even(spark):
    c = Chain(spark, SF0001, fixture="f2h")
    df = c.written()
    lk = c.lookups()
    stats = lookup_stats(lk)
    cols = ["row_key", "cs_ratio", "cs_known", "speaker_cred", "affil_cred", "ctx_cred"]
    hot = find_hot(df)
    # at this scale the ten suppliers are frequent too, guests are not
    assert "the-chair" in hot["speaker"] and hot["speaker"] == hot["speaker_cs"] and len(hot["context"]) == 5
    assert set(trained_hot(lk)["speaker"]) == set(hot["speaker"])
    plain = rows(feature_table(df, lk, stats).select(*cols))
    assert rows(feature_table(df, lk, stats, hot=hot).select(*cols)) == plain
    assert rows(feature_table(df, lk, stats, hot=trained_hot(lk)).select(*cols)) == plain
    compat = feature_table(df, lk, stats, key_mode="eval_compat")
    found = feature_table(df, lk, stats, key_mode="eval_compat", hot=find_hot(df, "eval_compat"))
    assert rows(found.select(*cols)) == rows(compat.select(*cols))
    with plain_shuffles(spark):
        sizes = task_sizes(feature_table(df, lk, stats, hot=hot))
        assert max(sizes) <= 3 * statistics.median(sizes), sizes


def test_policy_last_needs_keys_as_written(spark):
    data = [("a", " source-3", "true", 1), ("b", "source-3", "false", 0), ("c", "source-3", "true", 1)]
    df = spark.createDataFrame([(k, "s", lab, sp, None, None, y) for k, sp, lab, y in data],
                               "row_key string, statement string, label string, speaker_name string, speaker_affiliation string, "
                               "statement_context string, y int")
    with pytest.raises(ValueError, match="as written"):
        feature_table(df, all_lookups(df), policy="last")
    lk = all_lookups(df, strip=False)
    assert {r["speaker_cred"] for r in feature_table(df, lk, policy="last").collect()} == {0.5}
    assert {round(r["speaker_cred"], 3) for r in feature_table(df, lk).collect()} == {0.667}
    # probes are stripped in every mode, so as-written keys are pooled for raw ones
    assert {round(r["speaker_cred"], 3) for r in feature_table(df, lk, key_mode="raw").collect()} == {0.667}
