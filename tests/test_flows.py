"""Training, artifacts round trip, evaluation, and stream = batch."""

import pytest
from pyspark.sql import functions as F

from credo.plans import fixtures as fx
from credo.plans.scoring import score_requests
from credo.plans.training import train
from credo.session import scratch_dir
from credo.sources.artifacts import load_artifacts
from credo.sources.statements import normalize_statements
from credo.streaming.score_stream import lineitem_statement_stream, start
from tests.conftest import SF0001, rows


@pytest.fixture(scope="module")
def trained(spark):
    res = train(spark, normalize_statements(fx.f1(spark, "/root/testdata/sf0.01")), regs=(0.01,))
    return res, load_artifacts(spark, res["artifacts_dir"])


def test_artifacts_round_trip(spark, trained):
    res, art = trained
    assert rows(art["lookups"]) == rows(res["lookups"])
    assert art["threshold"] == pytest.approx(res["threshold"])
    assert art["model"] is not None


def test_lookups_only_from_train(spark, trained):
    res, _ = trained
    tr = res["split"].filter("split = 'train'")
    assert res["lookups"].filter("kind = 'all'").first()["n"] == tr.count()


def test_model_beats_majority_on_val(spark, trained):
    from credo.operators.modeling import batch_score
    from credo.operators.metrics import metrics_report
    res, art = trained
    assert res["val_ba"] >= 0.5


def test_stream_equals_batch(spark):
    res = train(spark, normalize_statements(fx.f2(spark, SF0001)), regs=(0.01,))
    art = load_artifacts(spark, res["artifacts_dir"])
    out, ck = scratch_dir(spark, "t-out"), scratch_dir(spark, "t-ck")
    start(lineitem_statement_stream(spark, SF0001), art, out, ck).awaitTermination()
    streamed = rows(spark.read.parquet(out))
    batch = rows(score_requests(fx.f2(spark, SF0001), art))
    assert len(streamed) == 6000
    assert streamed == batch


def test_stream_with_reload_equals_batch(spark):
    from credo.streaming.score_stream import start_with_reload

    res = train(spark, normalize_statements(fx.f2(spark, SF0001)), regs=(0.01,))
    out, ck = scratch_dir(spark, "t-rl-out"), scratch_dir(spark, "t-rl-ck")
    start_with_reload(lineitem_statement_stream(spark, SF0001), lambda: res["artifacts_dir"], out, ck).awaitTermination()
    streamed = rows(spark.read.parquet(out).drop("batch_id"))
    batch = rows(score_requests(fx.f2(spark, SF0001), load_artifacts(spark, res["artifacts_dir"])))
    assert streamed == batch


def test_embedding_model(spark):
    from credo.operators.modeling import batch_score, join_embeddings, train_model
    from credo.plans.chain import Chain

    c = Chain(spark, "/root/testdata/sf0.01", fixture="f1", split="stratified")
    f = join_embeddings(c.features(), fx.f5(spark, "/root/testdata/sf0.01"))
    m = train_model(f.filter("split = 'train'"), text="embedding")
    s = batch_score(m, f, text="embedding")
    assert s.count() == f.count()
    assert s.filter("prob < 0 OR prob > 1 OR prob IS NULL").count() == 0


def test_public_api_round_trip(spark):
    import os
    import tempfile

    from credo import api

    d = tempfile.mkdtemp(prefix="credo-api-")
    path = os.path.join(d, "data.csv")
    fx.f1(spark, "/root/testdata/sf0.01").drop("row_key").toPandas().to_csv(path, index=False)
    summary = api.train(path, spark=spark, regs=(0.1,))
    report = api.evaluate(path, summary["artifacts_dir"], spark=spark)
    assert set(report) >= {"accuracy", "balanced_accuracy", "auc_roc", "mcc", "f1", "precision", "recall"}
    out = api.predict({"statement": "The rate has reached a record low.", "speaker": "Source 3",
                       "speaker_affiliation": "EN", "context": "a press release"}, summary["artifacts_dir"], spark=spark)
    assert out["prediction"] in ("TRUE", "FALSE")
    assert out["explanation"].startswith("This statement is likely ")


def test_model_attributions_are_complete(spark):
    """intercept + numeric weight x value + word weights == logit, per row."""
    from pyspark.sql import functions as F

    from credo.functions.text import word_tokens
    from credo.operators.modeling import batch_score, coefficients, train_model, word_scores
    from credo.plans.chain import Chain

    c = Chain(spark, SF0001, fixture="f1")
    feats = c.features()
    # few terms: many words share one
    m = train_model(feats.filter("split = 'train'"), num_features=512, max_iter=10)
    numeric, intercept, _ = coefficients(m)
    words = F.array_distinct(word_tokens("statement", True))
    scored = batch_score(m, feats.withColumn("w", words)).select("row_key", "logit", word_scores(spark, m)(F.col("w")).alias("s"), *numeric)
    text = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    num = sum(F.lit(w) * F.col(n) for n, w in numeric.items())
    worst = scored.agg(F.max(F.abs(F.lit(intercept) + num + text - F.col("logit")))).first()[0]
    assert worst < 1e-6


def test_term_index_is_that_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF

    from credo.operators.modeling import term_index

    tf = HashingTF(inputCol="w", outputCol="o", numFeatures=1 << 16)
    for word in ["", "a", "ab", "abc", "abcd", "abcde", "é", "汉字", "the quick", "x" * 99]:
        assert term_index(word, 1 << 16) == tf.indexOf(word)


def test_terms_and_scores_of_many_words(spark):
    """A batch's words are hashed at once; the first of a list's words with one term has its weight."""
    import numpy as np
    import pyarrow as pa

    from credo.operators import modeling as mo

    words = ["", "a", "ab", "abc", "abcd", "abcde", "é", "汉字", "the quick", "x" * 99, "x" * 100, "\U0001f600", *map(str, range(500))]
    for size in (1 << 16, 1000):
        assert mo.term_indices(pa.array(["skipped", *words])[1:], size).tolist() == [mo.term_index(w, size) for w in words]
    weights = np.arange(1.0, 8.0)
    lists = [None, [], ["a"], ["a", "b", "c", "d", "e", "f", "g", "h"], ["h", "a"], None]
    want = []
    for row in lists:
        seen = set()
        terms = [mo.term_index(w, 7) for w in row or []]
        want.append([0.0 if t in seen or seen.add(t) else weights[t] for t in terms])
    assert mo.scores_of(pa.array([["z"], *lists], pa.list_(pa.string()))[1:], weights).to_pylist() == want
    none = mo.word_scores(spark, mo.linear_model(spark, dict.fromkeys(mo.NUMERIC, 1.0), 0.0))
    got = spark.createDataFrame([(x,) for x in lists], "w array<string>").select(none(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [[0.0] * len(x or []) for x in lists]


def test_evaluate_with_some_or_no_labels(spark, trained):
    from credo.plans.evaluation import evaluate

    _, art = trained
    rows_ = normalize_statements(fx.f1(spark, SF0001))
    known = rows_.count()
    part = evaluate(rows_.withColumn("label", F.when(F.ascii(F.right("row_key", F.lit(1))) % 2 == 0, F.col("label"))), art)
    r = part["report"].first()
    assert 0 < r["tn"] + r["fp"] + r["fn"] + r["tp"] < known
    assert part["predictions"].count() <= known
    for unlabelled, dedup in ((rows_.drop("label"), True), (rows_.withColumn("label", F.lit(None).cast("string")), False)):
        out = evaluate(unlabelled, art, dedup=dedup)
        assert out["report"] is None and out["confusion"] is None
        assert out["predictions"].count() == known
    test = evaluate(normalize_statements(fx.f1(spark, "/root/testdata/sf0.01")), art, split="test")
    assert test["scored"].count() == art["split"].filter("split = 'test'").count()


def test_incomplete_and_damaged_artifacts_are_not_taken(spark, tmp_path, trained):
    import shutil

    from credo.sources.artifacts import newest_complete, save_artifacts

    res, _ = trained
    assert newest_complete(spark, str(tmp_path)) is None
    first = save_artifacts(spark, str(tmp_path / "first"), res["lookups"], model=res["model"], split=res["split"])
    # a run that died before its manifest, though its parts are newer
    res["lookups"].write.parquet(str(tmp_path / "dead" / "lookups"))
    assert newest_complete(spark, str(tmp_path)).endswith("/first")
    with pytest.raises(ValueError, match="manifest"):
        load_artifacts(spark, str(tmp_path / "dead"))
    second = save_artifacts(spark, str(tmp_path / "second"), res["lookups"])
    assert newest_complete(spark, str(tmp_path)).endswith("/second")
    art = load_artifacts(spark, second)
    assert art["model"] is None and art["split"] is None
    assert load_artifacts(spark, first)["split"].count() == res["split"].count()
    # published, then damaged
    for name in (tmp_path / "first" / "model" / "metadata").glob("*part*"):
        name.unlink()
    with pytest.raises(Exception):
        load_artifacts(spark, first)
    shutil.copytree(tmp_path / "first" / "lookups", tmp_path / "second" / "lookups", dirs_exist_ok=True)
    with pytest.raises(ValueError, match="rows"):
        load_artifacts(spark, second)


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from credo import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
