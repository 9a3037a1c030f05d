"""Entry points with the shape of the original public API, on Spark.

    train(path, artifacts_dir)           -> summary dict (artifacts written)
    evaluate(path, artifacts_dir)        -> metrics of the labelled rows ({} for
                                            a file without labels)
    predict(record_or_df, artifacts_dir) -> {'prediction', 'explanation', 'prompt'}
                                            for one record, a DataFrame for a table
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _spark(spark: SparkSession | None) -> SparkSession:
    from credo.session import ensure_checkpoint_dir, get_session

    s = spark or SparkSession.getActiveSession() or get_session()
    ensure_checkpoint_dir(s)
    return s


def train(path: str, artifacts_dir: str | None = None, spark: SparkSession | None = None,
          fmt: str = "csv", **kwargs) -> dict:
    from credo.plans.training import train as run
    from credo.sources.statements import load_statements

    s = _spark(spark)
    res = run(s, load_statements(s, path, fmt), artifacts_dir, **kwargs)
    return {k: res[k] for k in ("artifacts_dir", "threshold", "candidate", "val_ba", "n_labelled", "n_dropped")}


def evaluate(path: str, artifacts_dir: str, spark: SparkSession | None = None, fmt: str = "csv",
             split: str | None = None) -> dict:
    from credo.plans.evaluation import evaluate as run
    from credo.sources.artifacts import load_artifacts
    from credo.sources.statements import load_statements

    s = _spark(spark)
    out = run(load_statements(s, path, fmt), load_artifacts(s, artifacts_dir), split=split)
    report = out["report"].first() if out["report"] is not None else None  # one row
    return report.asDict() if report else {}


def predict(record, artifacts_dir: str, spark: SparkSession | None = None):
    """One record (dict with statement and optional speaker / speaker_name,
    speaker_affiliation, context / statement_context) or a DataFrame of them."""
    from credo.plans.scoring import score_requests
    from credo.sources.artifacts import load_artifacts

    s = _spark(spark)
    art = load_artifacts(s, artifacts_dir)
    if isinstance(record, DataFrame):
        from credo.sources.statements import with_file_order_key

        df = record if "row_key" in record.columns else with_file_order_key(record)
        return score_requests(df, art)
    fields = ["statement", "speaker", "speaker_name", "speaker_affiliation", "context", "statement_context"]
    row = [("r0", *[None if record.get(f) is None else str(record.get(f)) for f in fields])]
    df = s.createDataFrame(row, "row_key string, " + ", ".join(f"{f} string" for f in fields))
    out = score_requests(df, art).first()  # one row
    return {"prediction": out["prediction"], "explanation": out["explanation"], "prompt": out["prompt"]}
