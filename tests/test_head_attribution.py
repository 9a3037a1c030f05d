"""Attributions of the two-layer head against numeric integration and plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credo.operators import head_attribution as ha
from credo.operators.attribution import word_positions

HEAD = {"W1": np.random.default_rng(1).normal(0, 2, (3, 4 + 5)).round(3), "b1": [0.1, -0.2, 0.0], "w2": [3.0, -4.0, 2.5], "b2": 0.3}
A, B = -2.0, 1.0
TEXTS = ["one two three two", "four one", None, "", "unseen words only", "three three three four one two"]
VECTORS = [[1.0, 0.0, -1.0, 0.5], [0.0, 2.0, 0.5, -0.5], None, [0.1, 0.2, 0.3, 0.4], None, [-1.0, 1.0, 1.0, 2.0]]


def statements(spark):
    r = np.random.default_rng(2)
    data = [(f"r{i}", t, v, *map(float, r.uniform(0, 1, 4)), float(r.normal())) for i, (t, v) in enumerate(zip(TEXTS, VECTORS))]
    return spark.createDataFrame(data, "row_key string, statement string, text_vec array<double>, cs_ratio double, speaker_cred double, "
                                       "affil_cred double, ctx_cred double, len_norm double")


def gathered(spark):
    df = statements(spark)
    pos = word_positions(df)
    # the statement of unseen words is no training statement
    words = ha.word_hidden(pos.filter("row_key <> 'r4'"), df.filter("row_key <> 'r4'"), HEAD)
    return df, ha.gathered(df, pos, words, HEAD, A, B)


def relu_head(c, m, t=1.0):
    return float(np.maximum(np.array(c) + t * np.array(m), 0) @ np.array(HEAD["w2"]) + HEAD["b2"])


def test_words_carry_their_mean_vectors(spark):
    df, rows = gathered(spark)
    w1 = np.array(HEAD["W1"])[:, :4]
    vec = {w: np.mean([np.array(v if v is not None else [0] * 4) for t, v in zip(TEXTS, VECTORS) if w in (t or "").split()], axis=0)
           for w in ("one", "two", "three", "four")}
    for r in rows.collect():
        own = (TEXTS[int(r["row_key"][1:])] or "").split()
        mean = np.mean([vec.get(w, np.zeros(4)) for w in own], axis=0) if own else np.zeros(4)
        assert r["m"] == pytest.approx((w1 @ mean).tolist())
        assert r["n"] == len(own) and [w["word"] for w in r["ws"]] == list(dict.fromkeys(own))


def test_contributions_sum_to_the_gap_but_for_delta(spark):
    df, rows = gathered(spark)
    for rule in ("gausslegendre", "midpoint"):
        deltas = []
        for steps in (1, 5, 20, 400):
            found = ha.with_path(rows, HEAD, steps, rule).withColumn("x", ha.path_contributions(HEAD)).collect()
            for r in found:
                gap = relu_head(r["c"], r["m"]) - relu_head(r["c"], r["m"], 0.0)
                total = sum(w["score"] for w in r["x"])
                assert abs(total - gap) == pytest.approx(r["delta"], abs=1e-9)
                assert r["quality"] == ("EXCELLENT" if r["delta"] < 0.05 else "ACCEPTABLE" if r["delta"] < 0.2 else "POOR")
                assert r["use_primary"] == (r["quality"] != "POOR")
            deltas.append(max(r["delta"] for r in found))
        assert deltas[0] > 0.05 and deltas[-1] < 0.02 and deltas[-1] < deltas[0]


def removal(key, words, c, w2, b2, n=50):
    """The same, word by word and sample by sample."""
    def prob(kept):
        total = sum(w["n"] for w in kept)
        text = sum((w["n"] * np.array(w["u"]) for w in kept), np.zeros(len(w2))) / total if total else np.zeros(len(w2))
        return 1 / (1 + np.exp(-(np.maximum(np.array(c) + text, 0) @ np.array(w2) + b2)))

    draws = [[s == 0 or int(hashlib.md5(f"{key}|{s}|{w['word']}".encode()).hexdigest()[1], 16) % 2 == 1 for w in words] for s in range(n)]
    out = []
    for i in range(len(words)):
        mean = {}
        for want in (True, False):
            mine = [(np.exp(-(1 - np.mean(d)) ** 2 / 0.0625), prob([w for w, k in zip(words, d) if k])) for d in draws if d[i] is want]
            mean[want] = sum(a * p for a, p in mine) / sum(a for a, _ in mine) if mine else 0.0
        out.append(mean[True] - mean[False])
    return out


def test_only_poor_rows_meet_the_second_explainer(spark, tmp_path):
    df, rows = gathered(spark)
    path = str(tmp_path / "rows")
    ha.with_path(rows, HEAD, 1).withColumn("use_primary", F.col("row_key") != "r5").write.parquet(path)
    stored = spark.read.parquet(path)
    out = ha.routed(stored, HEAD)
    found = {r["row_key"]: r for r in out.collect()}
    assert {k: r["method"] for k, r in found.items()} == {f"r{i}": "removal" if i == 5 else "gradients" for i in range(6)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("score(") == 1 and plan.count("Relation") == 2
    r = stored.filter("row_key = 'r5'").first()
    want = removal("r5", r["ws"], r["c"], HEAD["w2"], HEAD["b2"])
    best = sorted(zip(want, [w["word"] for w in r["ws"]]), key=lambda x: -abs(round(x[0], 9)))[:3]
    assert [(w["word"], pytest.approx(w["score"])) for w in found["r5"]["top"]] == [(w, s) for s, w in best]
    assert found["r2"]["top"] == [] == found["r3"]["top"] and found["r2"]["delta"] == 0


def test_expected_gradients_are_averaged_slopes(spark):
    df = statements(spark)
    neutral = {"cs_ratio": F.lit(0.5), "speaker_cred": F.lit(0.6), "affil_cred": F.lit(0.6), "ctx_cred": F.lit(0.6), "len_norm": F.lit(0.0)}
    table = ha.sample_table(7, seed=3)
    found = {r["row_key"]: list(r)[1:] for r in ha.expected_gradients(df, HEAD, A, B, neutral, table).collect()}
    w1, base = np.array(HEAD["W1"]), np.array([0.5, 0.6, 0.6, 0.6, 0.0])

    def f(vec, x):
        fused = np.concatenate((vec, [np.tanh(A * x[0] + B)], x[1:]))
        return np.maximum(w1 @ fused + HEAD["b1"], 0) @ np.array(HEAD["w2"])

    for r in df.collect():
        vec = np.array(r["text_vec"] or [0.0] * 4)
        x, total = np.array([r[n] for n in neutral]), np.zeros(5)
        for o, e, t in zip(table["offset"], table["noise"], table["at"]):
            gap = (x + e) - (base + o)
            point = base + o + t * gap
            step = 1e-6
            slope = [(f(vec, point + step * np.eye(5)[i]) - f(vec, point - step * np.eye(5)[i])) / (2 * step) for i in range(5)]
            total += np.array(slope) * gap
        assert found[r["row_key"]] == pytest.approx((total / 7).tolist(), rel=1e-4, abs=1e-6)


def test_empty_tables(spark):
    df, rows = gathered(spark)
    none = ha.with_path(rows.limit(0), HEAD)
    assert ha.routed(none, HEAD).count() == 0
    assert ha.expected_gradients(df.limit(0), HEAD, A, B, {n: F.lit(0.0) for n in ("cs_ratio", "speaker_cred", "affil_cred", "ctx_cred", "len_norm")}).count() == 0


def test_numbers_are_written_as_printf_does(spark):
    from credo.operators.explain import fill

    values = [i / 1000 for i in range(2000)] + [0.325, 1.005, 99.995, 2.675, 0.125, 0.375]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", fill("%.2f and %.0f", F.col("v"), F.col("v") * 100).alias("s")).collect():
        assert r["s"] == "%.2f and %.0f" % (r["v"], r["v"] * 100)


def test_head_is_scored_in_batches_of_a_fixed_size(spark):
    from credo.operators.modeling import fuse_features, head_score

    df = fuse_features(statements(spark).fillna(0.0), A, B).withColumn("fused", F.when(F.size("fused") == 9, F.col("fused")))
    df = df.filter("fused is not null")
    found = head_score(df, HEAD, batch_size=2)
    assert "predict" in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        want = np.maximum(np.array(HEAD["W1"]) @ np.array(r["fused"]) + HEAD["b1"], 0) @ np.array(HEAD["w2"]) + HEAD["b2"]
        assert r["logit"] == pytest.approx(want) and r["prob"] == pytest.approx(1 / (1 + np.exp(-want)))
    assert head_score(df.limit(0), HEAD).count() == 0


def test_texts_are_dealt_over_bounded_tasks(spark, monkeypatch):
    """Tasks follow the characters of the texts, and a statement's words are counted where they are."""
    from credo.plans import chain

    monkeypatch.setattr(chain, "TASK_CHARS", 10)
    df = statements(spark)
    dealt = chain.materialize_dealt(spark, df, "dealt", "statement")
    chars = sum(len(t or "") for t in TEXTS)
    assert dealt.rdd.getNumPartitions() == chars // 10 + 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    counts = word_positions(dealt).groupBy("row_key", "word").count()
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    empty = chain.materialize_dealt(spark, df.filter("false"), "dealt", "statement")
    assert empty.count() == 0 and empty.rdd.getNumPartitions() == 1
