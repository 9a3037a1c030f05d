"""Training: candidates together, exact dictionary, counts on the way; evaluation of every kind of model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credo.constants import FEATURE_NAMES
from credo.operators import dictionary as di
from credo.operators import modeling as mo
from credo.operators.attribution import word_positions
from credo.plans import fixtures as fx
from credo.plans.chain import Chain, labelled_counted, materialize
from credo.plans.evaluation import evaluate
from credo.plans.training import train
from credo.sources.artifacts import load_artifacts
from credo.sources.statements import normalize_statements
from tests.conftest import SF001, SF0001, rows


@pytest.fixture(scope="module")
def features(spark):
    c = Chain(spark, SF001, fixture="f1", split="stratified")
    return c.materialized("features", c.features())


def test_candidates_are_fitted_as_each_alone(spark, features):
    tr = features.filter("split = 'train'")
    regs = (0.01, 0.1, 1.0)
    together = mo.fit_candidates(tr, regs, num_features=256, max_iter=20)
    for reg, m in zip(regs, together):
        alone = mo.train_model(tr, reg, num_features=256, max_iter=20)
        assert m.stages[-1].getRegParam() == reg
        assert np.allclose(m.stages[-1].coefficients.toArray(), alone.stages[-1].coefficients.toArray(), atol=1e-4)


def test_candidates_are_scored_in_one_pass_and_chosen_by_the_operator(spark, features):
    from credo.operators.sweep import select_best

    tr, va = features.filter("split = 'train'"), features.filter("split = 'val'")
    models = mo.fit_candidates(tr, (0.01, 10.0), num_features=256, max_iter=20)
    table = mo.candidate_scores(models, va)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation") == va._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    for i, m in enumerate(models):
        one = [round(r["prob"], 9) for r in mo.batch_score(m, va).select("prob").collect()]
        assert sorted(one) == sorted(round(r["prob"], 9) for r in table.filter(F.col("candidate") == i).collect())
    idx, model, ba = mo.select_by_validation(tr, va, (0.01, 10.0), num_features=256, max_iter=20)
    best = select_best(table).filter("is_best").first()
    assert (idx, ba) == (best["candidate"], best["balanced_accuracy"])
    assert mo.select_by_validation(tr, va.limit(0), (0.01, 10.0), num_features=256, max_iter=5)[0] == 0


def test_terms_follow_the_number_of_words(spark):
    words = spark.createDataFrame([([f"w{i}" for i in range(3000)],), ([],), (None,)], "words array<string>")
    assert mo.sized_terms(words) in (4096, 8192)
    assert mo.sized_terms(words, most=2048) == 2048
    assert mo.sized_terms(words.limit(0)) == 1024


def test_dense_ids_are_the_ranks_of_the_words(spark):
    words = sorted({f"{'é' if i % 5 else 'z'}{i * 7919 % 1000}" for i in range(2000)}, key=str.encode)
    df = spark.createDataFrame([(w,) for w in reversed(words)], "word string").repartition(7)
    assert {r["word"]: r["id"] for r in di.dense_ids(df, "word").collect()} == {w: i for i, w in enumerate(words)}
    assert di.dense_ids(df.limit(0), "word").count() == 0


def test_gradient_is_the_derivative_of_the_loss(spark):
    """Against a numeric derivative of the weighted, penalized loss, away from the optimum."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(list("abcdef"), r.integers(0, 5))) for _ in range(40)]
    data = [(f"r{i}", t, int(r.integers(0, 2)), float(r.uniform(0.5, 2)), *map(float, r.normal(size=5))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "row_key string, statement string, y int, w double, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    present = di.presence(word_positions(df))
    words = di.word_dictionary(present)
    names = [x["word"] for x in words.orderBy("id").collect()]
    beta, intercept, reg = r.normal(size=5 + len(names)), 0.3, 0.05
    weighted = words.join(spark.createDataFrame([(n, float(b)) for n, b in zip(names, beta[5:])], "word string, weight double"), "word")
    found = {x["name"]: x["gradient"] for x in di.gradient(df, present, weighted, dict(zip(FEATURE_NAMES, beta[:5])), intercept, reg).collect()}
    x = np.array([[*d[4:], *((n in d[1].split()) for n in names)] for d in data], dtype=float)
    y, w = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    total = w.sum()
    mean = w @ x / total
    var = (w @ (x - mean) ** 2) / (total - (w @ w) / total)

    def loss(b, b0):
        z = x @ b + b0
        return (w @ (np.logaddexp(0, z) - y * z)) / total + reg / 2 * np.sum(var * b ** 2)

    step = 1e-6
    for i, n in enumerate([*FEATURE_NAMES, *names]):
        e = np.eye(len(beta))[i] * step
        assert found[n] == pytest.approx((loss(beta + e, intercept) - loss(beta - e, intercept)) / (2 * step), abs=1e-6)
    assert found["intercept"] == pytest.approx((loss(beta, intercept + step) - loss(beta, intercept - step)) / (2 * step), abs=1e-6)


def test_dictionary_fit_gives_each_word_its_weight(spark, features):
    """Words of f1 in a dictionary: as many weights as words, and a vanishing gradient."""
    tr = materialize(spark, mo.class_weights(features.filter("split = 'train'")).select("row_key", "statement", "y", "w", *FEATURE_NAMES), "tr")
    present = materialize(spark, di.presence(word_positions(tr)), "present")
    words = di.word_dictionary(present)
    block = di.term_vectors(tr, present, words).select(F.col("y").cast("double").alias("y"), "w", "features")
    m = mo.classifier(0.1, max_iter=300, tol=1e-9).fit(block)
    assert m.numFeatures == 5 + present.select("word").distinct().count()
    numeric = dict(zip(FEATURE_NAMES, m.coefficients.toArray()))
    worst = di.gradient(tr, present, di.weights_of(m, words), numeric, m.intercept, 0.1).agg(F.max(F.abs("gradient"))).first()[0]
    assert worst < 1e-3


def test_unknown_labels_are_counted_in_the_same_pass(spark):
    data = [("a", "x", "true"), ("b", "y", "pants-fire"), ("c", "z", None), ("d", "x", "true"), ("e", "v", "FALSE ")]
    df = spark.createDataFrame([(*d, None, None, None) for d in data],
                               "row_key string, statement string, label string, speaker_name string, speaker_affiliation string, statement_context string")
    kept, counted = labelled_counted(df)
    kept = materialize(spark, kept, "kept")
    assert counted.get == {"n_rows": 4, "n_dropped": 2} and kept.count() == 2


@pytest.mark.parametrize("text", ["embedding", False, True])
def test_every_kind_of_model_is_evaluated(spark, text):
    statements = normalize_statements(fx.f1(spark, SF0001))
    vectors = fx.f5(spark, SF0001)
    res = train(spark, statements, regs=(0.1,), text=text, max_iter=10, embeddings=vectors if text == "embedding" else None)
    art = load_artifacts(spark, res["artifacts_dir"])
    assert res["n_labelled"] == res["split"].count() and res["n_dropped"] >= 0
    if text == "embedding":
        with pytest.raises(ValueError, match="embeddings"):
            evaluate(statements, art)
    out = evaluate(statements, art, embeddings=vectors)
    r = out["report"].first()
    # duplicates and contradictions don't count
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == res["n_labelled"]
    probs = {x["row_key"]: x["prob"] for x in out["scored"].collect()}
    assert all(0 <= p <= 1 and not math.isnan(p) for p in probs.values())


def test_given_weights_survive_a_round_trip(spark, tmp_path):
    weights = {n: 0.5 * i - 1 for i, n in enumerate(FEATURE_NAMES)}
    mo.linear_model(spark, weights, 0.25).write().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    m = PipelineModel.load(str(tmp_path / "m"))
    assert mo.coefficients(m, text=False)[:2] == (weights, 0.25)
    df = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4, 0.5)], "row_key string, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    want = 1 / (1 + math.exp(-(0.25 + sum(w * x for w, x in zip(weights.values(), (0.1, 0.2, 0.3, 0.4, 0.5))))))
    assert mo.batch_score(m, df, text=False).first()["prob"] == pytest.approx(want)


def test_stream_is_stopped_between_files_and_goes_on(spark):
    """Each file once: batches before the stop and after it, and none twice."""
    from credo.plans.catalog import _given_artifacts
    from credo.plans.scoring import score_requests
    from credo.session import scratch_dir
    from credo.streaming.score_stream import lineitem_statement_stream, start

    _, art = _given_artifacts(spark, SF0001)
    lines = fx.table(spark, SF0001, "lineitem")
    out, ck, inbox = (scratch_dir(spark, f"t-{n}") for n in ("out", "ck", "in"))
    seen = []
    for part in ((0, 1), (), (2,)):
        for k in part:
            lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(inbox)
        if part or seen:
            q = start(lineitem_statement_stream(spark, SF0001, arrivals=inbox), art, out, ck)
            q.awaitTermination()
            seen.append(sum(p["numInputRows"] > 0 for p in q.recentProgress))
    assert seen == [2, 0, 1]
    assert rows(spark.read.parquet(out)) == rows(score_requests(fx.f2(spark, SF0001), art))


def test_vocabulary_stays_out_of_metadata_and_empty_terms_out_of_the_fit(spark):
    """Vectors describe no term by an attribute, a fit sees used columns only, and weights are dense for scoring."""
    rows = spark.createDataFrame([(f"r{i}", f"word{i} common", i % 2, 0.1 * i, 0.2, 0.3, 0.4, 0.5) for i in range(8)],
                                 "row_key string, statement string, y int, cs_ratio double, speaker_cred double, affil_cred double, "
                                 "ctx_cred double, len_norm double")
    stages = mo.front_stages(True, 1 << 12)
    front = mo.through(stages, mo.with_text(mo.class_weights(rows), True))
    assert front.schema["features"].metadata["ml_attr"]["num_attrs"] < 10
    assert front.first()["features"].size == 5 + (1 << 12)
    block, columns = mo.used_columns(front.select(F.col("y").cast("double").alias("y"), "w", "features"))
    terms = {mo.term_index(w, 1 << 12) for w in ["common", *(f"word{i}" for i in range(8))]}
    assert columns.tolist() == [0, 1, 2, 3, 4, *sorted(5 + t for t in terms)]
    key = lambda r: (r["y"], r["features"].toArray().tolist())
    wanted = [(r["y"], r["features"].toArray()[columns].tolist()) for r in front.collect()]
    assert sorted(map(key, block.collect())) == sorted(wanted)
    m = mo.train_model(rows, num_features=1 << 12, max_iter=20)
    last = m.stages[-1]
    assert last._java_obj.coefficientMatrix().getClass().getSimpleName() == "DenseMatrix"
    assert last.coefficients.size == 5 + (1 << 12) and set(np.nonzero(last.coefficients.toArray())[0]) <= set(columns.tolist())
    plain = {r["row_key"]: r["p"] for r in m.transform(mo.with_text(rows, True)).select("row_key", mo.vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(r["prob"] - plain[r["row_key"]]) < 1e-12 for r in mo.batch_score(m, rows).collect())


def test_arrivals_are_written_by_all_tasks_and_read_in_four_batches(spark, tmp_path, monkeypatch):
    """Quarters of a table of several files: none goes through one task, and each run of the stream has two micro-batches."""
    import shutil

    from credo.plans import catalog
    from credo.streaming import score_stream as st

    for t in ("orders", "supplier", "nation"):
        shutil.copyfile(f"{SF0001}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF0001}/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    runs, start = [], st.start
    monkeypatch.setattr(st, "start", lambda *a, **k: runs.append(start(*a, **k)) or runs[-1])
    out = catalog.score_stream(spark, str(tmp_path))
    assert [sum(p["numInputRows"] > 0 for p in r.recentProgress) for r in runs] == [2, 2]
    want = catalog.score_stream(spark, SF0001)
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_features_are_joined_once_for_fits_choice_and_sweep(spark, monkeypatch):
    from tests.test_plan_shapes import plan_of

    seen, select = [], mo.select_by_validation
    monkeypatch.setattr(mo, "select_by_validation", lambda tr, va, *a: seen.extend((tr, va)) or select(tr, va, *a))
    train(spark, normalize_statements(fx.f2(spark, SF0001)), regs=(0.01,), num_features=256, max_iter=3)
    for rows_ in seen:
        assert "words" in rows_.columns and rows_.count() > 0
        assert "Join" not in plan_of(rows_) and "regexp" not in plan_of(rows_)


def test_weights_reach_the_words_without_rows_on_the_driver(spark, monkeypatch):
    from types import SimpleNamespace

    words = spark.createDataFrame([("b", 2, 1), ("a", 5, 0), ("c", 1, 2)], "word string, n long, id long")
    model = SimpleNamespace(coefficients=SimpleNamespace(toArray=lambda: np.array([9.0] * 5 + [0.5, -1.5, 2.5])))
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    got = di.weights_of(model, words)
    assert got.columns == ["word", "n", "id", "weight"]
    assert sorted(map(tuple, got.collect())) == [("a", 5, 0, 0.5), ("b", 2, 1, -1.5), ("c", 1, 2, 2.5)]
