"""Stateless scoring and explanation of request rows -- the same column
expressions serve batch tables and streams.

Per row: resolve aliases -> clean text -> lookup joins (static, small or
AQE-planned) -> model -> word contributions from the model's own text
weights (gathered in an Arrow batch UDF) -> numeric attributions (closed form for the linear model) -> evidence
lines -> rule-based explanation.  Nothing groups across rows, so a stream
needs no state and the batch job no extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credo.constants import CS_DEFAULT, FEATURE_NAMES, TOP_WORDS
from credo.functions.text import standardize_format, word_tokens
from credo.operators.attribution import baseline_samples, neutral_point, word_positions
from credo.operators.explain import explain_rows
from credo.functions.scoring import decide
from credo.operators.features import feature_table, trained_hot
from credo.operators.lookups import lookup_stats
from credo.operators.modeling import batch_score, coefficients, join_embeddings, word_scores
from credo.sources.statements import resolve_aliases

def explain_head(feats: DataFrame, embeddings: DataFrame, words: DataFrame, head: dict, cs_a: float, cs_b: float,
                 threshold: float, default_cred: float, cs_default: float = CS_DEFAULT, steps: int = 20, samples: dict | None = None,
                 with_prompt: bool = False) -> DataFrame:
    """Decisions of the two-layer head, explained; words by the explainer that each row's completeness asks for.

    feats: ``feature_table`` rows with the statement; embeddings: (row_key,
    text_vec); words: ``word_hidden`` of the training statements.  The rows
    with their words are written once.  Their completeness delta is measured
    there, and only POOR rows meet the second explainer.  Returns row_key,
    prediction, confidence, top_words, explanation, delta, quality, method
    (and prompt).
    """
    from credo.operators import head_attribution as ha
    from credo.plans.chain import materialize

    rows = join_embeddings(feats, embeddings)
    rows = ha.gathered(rows, word_positions(rows), words, head, cs_a, cs_b)
    rows = materialize(feats.sparkSession, ha.with_path(rows, head, steps), "head-rows")
    named = ha.routed(rows, head).select("row_key", "delta", "quality", "method",
                                         F.array_join(F.transform("top", lambda x: x["word"]), ", ").alias("top_words"))
    scored = feats.join(rows.select("row_key", "m", ha.head_prob(head).alias("prob")), "row_key").join(named, "row_key")
    point = {n: F.lit(float(v)) for n, v in neutral_point(cs_default, default_cred).items()}
    keep = ("row_key", "statement", "prob", "cs_known", *FEATURE_NAMES, "delta", "quality", "method", "top_words")
    scored = ha.expected_gradients(scored, head, cs_a, cs_b, point, samples, text=F.col("m"), keep=keep)
    scored = scored.withColumns({alias: F.col(name) for name, alias in VALUE_COLS.items() if alias != name})
    return explain_rows(scored, None, threshold, float(default_cred), statement_col="statement", with_prompt=with_prompt,
                        keep=("delta", "quality", "method"))


VALUE_COLS = {"cs_ratio": "cs_val", "speaker_cred": "spk_cred", "affil_cred": "afl_cred",
              "ctx_cred": "ctx_cred", "len_norm": "len_norm"}


def score_requests(requests: DataFrame, artifacts: dict, clean_text: bool | None = None,
                   explain: bool = True, embeddings: DataFrame | None = None) -> DataFrame:
    """Requests (statement, speaker/speaker_name, speaker_affiliation,
    context/statement_context, row_key) -> prediction, probability,
    explanation and the prompt for a text generator.  Works on batch and
    streaming DataFrames.  Text is cleaned as it was for training unless
    ``clean_text`` says otherwise; a model trained on sentence vectors takes
    them from ``embeddings`` (row_key, text_vec) and names no words."""
    if clean_text is None:
        clean_text = bool(artifacts.get("clean_text", True))
    mode = artifacts.get("text", "words")
    spark = requests.sparkSession
    lookups = artifacts["lookups"]
    model = artifacts["model"]
    threshold = float(artifacts["threshold"])
    cs_default = float(artifacts.get("cs_default", CS_DEFAULT))
    key_mode = artifacts.get("key_mode", "normalized")
    stats_row = lookup_stats(lookups).first()  # the one 'all' row of the artifact
    stats = {"default_cred": stats_row["default_cred"], "len_mean": stats_row["len_mean"],
             "len_std": stats_row["len_std"]}
    df = resolve_aliases(requests)
    if clean_text:
        df = df.withColumn("statement", standardize_format("statement"))
    # requests may be a stream, so hot keys are those of training
    feats = feature_table(df, lookups, stats, key_mode=key_mode, cs_default=cs_default, clean_text=False,
                          hot=trained_hot(lookups, key_mode))
    feats = feats.withColumn("words", word_tokens("statement", clean=False))
    if mode == "embedding":
        feats = join_embeddings(feats, embeddings)
    scored = batch_score(model, feats, {"words": True, "none": False}.get(mode, mode), keep=("words",))
    scored = scored.withColumn("probability", F.bround("prob", 4))
    if not explain:
        return scored.select("row_key", decide("prob", threshold).alias("prediction"), "probability")
    numeric_w, _, _ = coefficients(model)
    # word contributions: the word's own weight (exact IG for a linear model);
    # presence features: each distinct word (first occurrence order) counts once
    scored = scored.withColumn("words", F.array_distinct("words") if mode == "words" else F.array().cast("array<string>"))
    scored = scored.withColumn("_wscores", word_scores(spark, model)(F.col("words")))
    ranked = F.sort_array(F.transform(F.arrays_zip(F.col("words").alias("w"), F.col("_wscores").alias("s"),
                                                   F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))).alias("p")),
                                      lambda x: F.struct((F.lit(0.0) - F.abs(x["s"])).alias("k"), x["p"].alias("p"),
                                                         x["w"].alias("w"))))
    top = F.transform(F.slice(F.filter(ranked, lambda x: x["w"].isNotNull()), 1, TOP_WORDS), lambda x: x["w"])
    scored = scored.withColumn("top_words", F.array_join(top, ", "))
    # numeric attributions against the neutral baselines
    base, noise = baseline_samples(cs_default, stats["default_cred"])
    for name in FEATURE_NAMES:
        scored = scored.withColumn(f"a_{name}", F.lit(float(numeric_w[name])) * (
            F.col(name) + F.lit(float(noise[name])) - F.lit(float(base[name]))))
    for name, alias in VALUE_COLS.items():
        if alias != name:
            scored = scored.withColumn(alias, F.col(name))
    out = explain_rows(scored, None, threshold, float(stats["default_cred"]), statement_col="statement",
                       with_prompt=True, keep=("probability",))
    return out.select("row_key", "prediction", "probability", "explanation", "prompt")
