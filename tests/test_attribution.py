import pytest
from pyspark.sql import functions as F

from credo.operators import attribution as at
from credo.operators.attribution import merge_subwords, top_words
from tests.conftest import rows

SCHEMA = "row_key string, pos long, token string, score double"


def test_docstring_example(spark):
    df = spark.createDataFrame([("r", 1, "un", .01), ("r", 2, "##employ", .03), ("r", 3, "##ment", .02),
                                ("r", 4, "is", .05)], SCHEMA)
    out = rows(merge_subwords(df), "word_pos", "word", "score")
    assert [(p, w) for p, w, _ in out] == [(1, "unemployment"), (4, "is")]
    assert out[0][2] == pytest.approx(.06) and out[1][2] == pytest.approx(.05)


def test_leading_pieces_and_cls(spark):
    df = spark.createDataFrame([("a", 1, "##a", .1), ("a", 2, "##b", .2), ("a", 3, "x", .3),
                                ("b", 1, "[CLS]", .0), ("b", 2, "##zz", .1)], SCHEMA)
    out = rows(merge_subwords(df), "row_key", "word")
    assert out == [("a", "##ab"), ("a", "x"), ("b", "[CLS]zz")]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5])
def test_chunking_does_not_change_words(spark, chunk):
    toks = ["a", "##b", "##c", "##d", "e", "##f", "g", "##h", "##i", "##j", "##k", "l"]
    data = [("r", i + 1, t, float(i)) for i, t in enumerate(toks)] + [("s", 1, "##x", 1.0), ("s", 2, "##y", 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(merge_subwords(df, chunk=chunk)) == rows(merge_subwords(df, chunk=1000))


def test_top_words_ties_keep_text_order(spark):
    df = spark.createDataFrame([("r", 1, "a", .1), ("r", 2, "b", -.3), ("r", 3, "c", .3), ("r", 4, "d", .0),
                                ("r", 5, "e", .2)], "row_key string, word_pos long, word string, score double")
    out = rows(top_words(df), "rank", "word")
    assert out == [(1, "b"), (2, "c"), (3, "e")]


def test_route_attributions(spark):
    from credo.operators.attribution import route_attributions

    prim = spark.createDataFrame([("a", 1, "x", .5), ("b", 1, "y", .4)], "row_key string, rank int, word string, score double")
    delta = spark.createDataFrame([("a", 0.01, "EXCELLENT", True), ("b", 0.5, "POOR", False)],
                                  "row_key string, delta double, quality string, use_primary boolean")
    fb = lambda keys: keys.select("row_key", F.lit(1).alias("rank"), F.lit("z").alias("word"), F.lit(0.1).alias("score"))
    out = rows(route_attributions(prim, delta, fb), "row_key", "word", "method")
    assert out == [("a", "x", "primary"), ("b", "z", "fallback")]


def test_perturbation_draws_samples_inside_the_row(spark):
    """One row per statement meets the samples: no 50-fold rows, no shuffle by sample."""
    from credo.operators.attribution import perturbation_attribution

    pos = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("q", 1, "a")], "row_key string, pos long, word string")
    base = spark.createDataFrame([("r", 0.0), ("q", 0.1)], "row_key string, base double")
    coef = spark.createDataFrame([("a", 2.0)], "word string, coef double")
    out = perturbation_attribution(pos, base, coef)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "explode(sequence" not in plan
    got = {(r["row_key"], r["rank"]): r["word"] for r in out.collect()}
    assert got == {("r", 1): "a", ("r", 2): "b", ("q", 1): "a"}


def test_removal_runs_in_batches_and_keeps_its_scores(spark):
    """Word removal as plain loops; no interpreted lambda per word and sample in the plan."""
    import hashlib
    import math

    words = {"a": ["x", "y", "z", "y"], "b": ["x"], "c": ["u", "x"]}
    coef = {"x": 0.5, "y": -1.25, "u": 30.0}
    pos = spark.createDataFrame([(k, i + 1, w) for k, ws in words.items() for i, w in enumerate(ws)], "row_key string, pos bigint, word string")
    base = spark.createDataFrame([("a", 0.1), ("b", -0.2), ("c", None)], "row_key string, base double")
    out = at.perturbation_attribution(pos, base, spark.createDataFrame([*coef.items()], "word string, coef double"), n_samples=8)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")
    found = {(r["row_key"], r["word"]): r["score"] for r in out.collect()}
    for key, b in (("a", 0.1), ("b", -0.2), ("c", None)):
        names = sorted(set(words[key]))
        tries = []
        for s in range(8):
            keep = {w: s == 0 or hashlib.md5(f"{key}|{s}|{w}".encode()).digest()[0] & 1 == 1 for w in names}
            logit = (b or 0.0) + sum(words[key].count(w) * coef.get(w, 0.0) for w in names if keep[w])
            tries.append((keep, 1 / (1 + math.exp(-logit)), math.exp(-((1 - sum(keep.values()) / len(names)) ** 2) / 0.0625)))
        for w in names:
            mean = {k: (sum(p * t for q, p, t in tries if q[w] == k) / n if (n := sum(t for q, p, t in tries if q[w] == k)) else 0.0) for k in (True, False)}
            assert found[key, w] == pytest.approx(0.0 if b is None else mean[True] - mean[False], abs=1e-12)
