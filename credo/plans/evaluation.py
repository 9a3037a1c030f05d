"""Evaluation flow: artifacts + statements -> predictions, and metrics where there are labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credo.functions.labels import binary_label, normalize_label
from credo.functions.text import standardize_format
from credo.operators.dedup import deduplicate
from credo.operators.features import feature_table, trained_hot
from credo.operators.lookups import lookup_stats
from credo.operators.metrics import confusion_matrix, has_labels, metrics_report
from credo.operators.modeling import batch_score, join_embeddings
from credo.plans.chain import materialize
from credo.sources.sinks import predictions


#: What the model reads of a statement's text, by the artifact's ``text``.
MODES = {"words": True, "none": False, "embedding": "embedding"}


def evaluate(statements: DataFrame, artifacts: dict, split: str | None = None, clean_text: bool | None = None,
             embeddings: DataFrame | None = None, dedup: bool = True) -> dict:
    """Score every row; metrics over the rows with a known label.

    The text mode is the artifact's: a model trained on sentence vectors takes
    them from ``embeddings`` (row_key, text_vec; zeros where there is none).
    Labelled rows are deduplicated first as for training (exact copies, then
    statements with contradicting labels), unless ``dedup`` is off; without a
    label column every row is scored.

    ``split`` keeps the rows that training put into that split, by the split
    table saved with the artifacts (so for the file that was trained on).
    Without any label, or without the column, there are predictions only and
    report and confusion are None.  Text is cleaned as it was for training
    unless ``clean_text`` says otherwise.
    """
    if clean_text is None:
        clean_text = bool(artifacts.get("clean_text", True))
    rows = statements
    if split is not None:
        if artifacts.get("split") is None:
            raise ValueError("these artifacts have no split table")
        chosen = artifacts["split"].filter(F.col("split") == split).select("row_key")
        rows = rows.join(chosen, "row_key", "left_semi")
    mode = artifacts.get("text") or "words"
    if mode == "embedding" and embeddings is None:
        raise ValueError("this model reads sentence vectors: give embeddings (row_key, text_vec)")
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
        dedup = False
    rows = rows.withColumn("label", normalize_label("label"))
    rows = (deduplicate(rows) if dedup else rows).withColumn("y", binary_label("label"))
    lk, key_mode = artifacts["lookups"], artifacts.get("key_mode", "normalized")
    feats = feature_table(rows, lk, lookup_stats(lk), key_mode=key_mode, cs_default=float(artifacts.get("cs_default", 0.5)),
                          clean_text=clean_text, hot=trained_hot(lk, key_mode))
    if clean_text:
        feats = feats.withColumn("statement", standardize_format("statement"))
    if mode == "embedding":
        feats = join_embeddings(feats, embeddings)
    # read by the label check, the counts and the AUC, so written once
    scored = batch_score(artifacts["model"], feats, MODES[mode]).select("row_key", "y", "prob")
    scored = materialize(statements.sparkSession, scored, "scored")
    t = float(artifacts["threshold"])
    out = {"scored": scored, "predictions": predictions(scored, t), "report": None, "confusion": None}
    if has_labels(scored, "y").first()["has_labels"]:  # one row
        known = scored.filter(F.col("y").isNotNull())
        out |= {"report": metrics_report(known, t), "confusion": confusion_matrix(known, t)}
    return out
