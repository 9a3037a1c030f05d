import random

import pytest
from pyspark.sql import functions as F

from credo.constants import THRESHOLDS
from credo.operators.metrics import auc_roc, confusion_counts, metrics_report
from credo.operators.sweep import threshold_sweep


def brute_auc(data):
    pos = [p for y, p in data if y == 1]
    neg = [p for y, p in data if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def make(spark, n=400, seed=1, levels=37):
    rng = random.Random(seed)
    data = [(rng.randint(0, 1), round(rng.randint(0, levels) / levels, 4)) for _ in range(n)]
    return data, spark.createDataFrame(data, "y int, prob double")


def test_auc_exact_with_ties(spark):
    data, df = make(spark)
    assert auc_roc(df).first()["auc_roc"] == pytest.approx(round(brute_auc(data), 6), abs=1e-9)


def test_auc_properties(spark):
    data, df = make(spark, seed=3)
    a = auc_roc(df).first()["auc_roc"]
    flipped = auc_roc(df.withColumn("prob", 1 - F.col("prob"))).first()["auc_roc"]
    squashed = auc_roc(df.withColumn("prob", F.col("prob") * F.col("prob") / 2)).first()["auc_roc"]
    assert flipped == pytest.approx(1 - a, abs=2e-6)
    assert squashed == pytest.approx(a, abs=1e-9)


def test_one_class_and_cells(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, prob double")
    r = metrics_report(df, 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (0, 0, 1, 1)
    assert r["balanced_accuracy"] == 0.5 and r["auc_roc"] is None and r["mcc"] == 0.0
    data, df = make(spark, seed=5)
    c = confusion_counts(df, 0.5).first()
    assert c["tn"] + c["fp"] + c["fn"] + c["tp"] == len(data)


def test_sweep_matches_brute_force(spark):
    data, df = make(spark, seed=7, levels=100)
    sw = {r["i"]: r for r in threshold_sweep(df).collect()}
    best_ba, best_i = -1, None
    for i, t in enumerate(THRESHOLDS):
        tp = sum(1 for y, p in data if y == 1 and p >= t)
        fn = sum(1 for y, p in data if y == 1 and p < t)
        tn = sum(1 for y, p in data if y == 0 and p < t)
        fp = sum(1 for y, p in data if y == 0 and p >= t)
        ba = (tp / (tp + fn) + tn / (tn + fp)) / 2
        assert (sw[i]["tp"], sw[i]["fp"], sw[i]["tn"], sw[i]["fn"]) == (tp, fp, tn, fn)
        assert sw[i]["balanced_accuracy"] == pytest.approx(round(ba, 6))
        if ba > best_ba:
            best_ba, best_i = ba, i
    assert [i for i, r in sw.items() if r["is_best"]] == [best_i]
    assert THRESHOLDS[5] == 0.35000000000000003 and THRESHOLDS[18] == 0.48000000000000015


def test_null_groups_and_null_probabilities(spark):
    from credo.operators.metrics import auc_roc, confusion_counts, metrics_by_group

    rows_ = [(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.8), ("a", 0, 0.2), ("a", 1, None), ("b", 0, 0.4)]
    df = spark.createDataFrame(rows_, "g string, y int, prob double")
    assert {r["g"]: r["auc_roc"] for r in auc_roc(df, ["g"]).collect()} == {None: 1.0, "a": 1.0, "b": None}
    assert {r["g"]: r["auc_roc"] for r in metrics_by_group(df, "g", 0.5).collect()} == {None: 1.0, "a": 1.0, "b": None}
    c = confusion_counts(df, 0.5).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (3, 0, 0, 2)


def test_auc_of_crowded_and_unbounded_scores(spark):
    import random

    from credo.operators.metrics import auc_roc

    rng = random.Random(1)
    rows_ = [(rng.randrange(2), rng.choice([1e-9, 1e-7, 0.9999999, -3.5, 40.0, 1e12]) * (1 + rng.randrange(40) / 100)) for _ in range(400)]
    pos, neg = [p for y, p in rows_ if y], [p for y, p in rows_ if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = auc_roc(spark.createDataFrame(rows_, "y int, prob double")).first()["auc_roc"]
    assert abs(got - want) < 1e-6
