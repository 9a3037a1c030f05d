"""Word- and feature-level attributions as DataFrame jobs.

Token tables are long: (row_key, pos, token, score[, mask]).

``merge_subwords`` glues WordPiece continuation pieces ('##...') to the
word before them and sums their scores.  It never puts a whole document in
one task: positions are cut into fixed-size chunks, word starts are found
inside each (row_key, chunk) window partition (bounded by the chunk size),
and a word that begins in an earlier chunk is found through a per-chunk
summary table (one row per chunk).  Pieces of the same word are
pre-aggregated inside their chunk before the final shuffle by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credo.constants import DELTA_ACCEPTABLE, DELTA_EXCELLENT, SPECIAL_TOKENS, TOP_WORDS
from credo.operators.skew import split_join

CHUNK = 8192


def mask_filter(tokens: DataFrame, mask: str = "mask") -> DataFrame:
    """Keep real-token positions only (mask = 1)."""
    return tokens.filter(F.col(mask) == 1)


def drop_special_tokens(df: DataFrame, col: str = "token") -> DataFrame:
    """Remove [CLS], [SEP] and [PAD] (not [UNK])."""
    return df.filter(~F.col(col).isin(*SPECIAL_TOKENS))


def merge_subwords(tokens: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row_key, pos, token, score) -> (row_key, word_pos, word, score).

    A '##' piece continues the previous piece's word when there is one; a
    '##' piece at the very start of a sequence begins a word and keeps its
    '##'.  ``word_pos`` is the position of the word's first piece.
    """
    cont = F.col("token").startswith("##")
    # both readers of the tokens drop rows without a key: said here, they read one shuffle
    t = (tokens.filter(F.col("row_key").isNotNull()).select("row_key", F.col("pos").cast("bigint").alias("pos"), "token", "score")
         .withColumn("_chunk", F.floor((F.col("pos") - 1) / chunk))
         .withColumn("_begin", F.when(~cont, F.col("pos"))))
    part = Window.partitionBy("row_key", "_chunk")
    run = part.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_local", F.max("_begin").over(run)).withColumn("_cmin", F.min("pos").over(part))
    summ = t.groupBy("row_key", "_chunk").agg(F.max("_begin").alias("_last"), F.min("pos").alias("_first"))
    prev = Window.partitionBy("row_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select("row_key", "_chunk",
                       F.coalesce(F.max("_last").over(prev), F.min("_first").over(prev)).alias("_carry"))
    j = t.join(summ, ["row_key", "_chunk"])
    start = F.coalesce("_local", "_carry", "_cmin")
    j = j.withColumn("_start", start)
    piece = F.when(F.col("pos") == F.col("_start"), F.col("token")).otherwise(F.substring("token", 3, 1 << 30))
    words = j.groupBy("row_key", F.col("_start").alias("word_pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", piece.alias("p"), "score"))).alias("_pieces"))
    # scores are added left to right in text order, as a running merge would
    score = F.aggregate("_pieces", F.lit(0.0), lambda acc, x: acc + x["score"])
    return words.select("row_key", "word_pos",
                        F.array_join(F.transform("_pieces", lambda x: x["p"]), "").alias("word"),
                        score.alias("score"))


def top_words(words: DataFrame, k: int = TOP_WORDS, word: str = "word", order: str = "word_pos") -> DataFrame:
    """The k words with the largest |score| per row; ties keep text order.

    The row_number filter is planned as a group limit, applied before the
    shuffle as well, so a long document sends at most k rows per task."""
    w = Window.partitionBy("row_key").orderBy(F.abs("score").desc(), F.col(order))
    return (words.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("row_key", "rank", word, "score"))


def words_list(top: DataFrame, word: str = "word") -> DataFrame:
    """(row_key, rank, word) -> (row_key, top_words 'a, b, c'); k rows per key."""
    return top.groupBy("row_key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", word))),
                                 lambda x: x[word]), ", ").alias("top_words"))


def completeness_delta(contrib: DataFrame, target: DataFrame, score: str = "score",
                       target_col: str = "target") -> DataFrame:
    """|sum of contributions - (f(x) - f(baseline))| per row, and its band.

    contrib: (row_key, score) rows; target: (row_key, target)."""
    s = contrib.groupBy("row_key").agg(F.sum(score).alias("_sum"))
    j = target.join(s, "row_key", "left")
    delta = F.abs(F.coalesce(F.col("_sum"), F.lit(0.0)) - F.col(target_col))
    # bands are decided at 1e-9, so float summation order cannot flip them
    j = j.withColumn("delta", delta).withColumn("_band", F.round("delta", 9))
    quality = (F.when(F.col("_band") < DELTA_EXCELLENT, F.lit("EXCELLENT"))
               .when(F.col("_band") < DELTA_ACCEPTABLE, F.lit("ACCEPTABLE"))
               .otherwise(F.lit("POOR")))
    return j.select("row_key", (F.round("delta", 6) + F.lit(0.0)).alias("delta"), quality.alias("quality"),
                    (F.col("_band") < DELTA_ACCEPTABLE).alias("use_primary"))


def word_positions(df: DataFrame, text_col: str = "statement", clean: bool = True) -> DataFrame:
    """Statements -> (row_key, pos, word) over the whole text."""
    from credo.functions.text import word_tokens

    return df.select("row_key", F.posexplode(word_tokens(text_col, clean)).alias("pos", "word")) \
             .withColumn("pos", F.col("pos").cast("bigint") + 1)


def word_counts(positions: DataFrame) -> DataFrame:
    """(row_key, word, n, first_pos): a statement's distinct words; tables that have ``n`` pass as they are."""
    if "n" in positions.columns:
        return positions
    return positions.groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def text_attribution(positions: DataFrame, coef: DataFrame, key: str = "word",
                     presence: bool = False, hot: list[int] | None = None) -> DataFrame:
    """Linear text model: each occurrence of a word contributes its weight
    (integrated gradients from an empty baseline are exact for a linear
    model).  Occurrences are first counted per (row, word), so a very common
    word is pre-aggregated before it meets the coefficient table; with ``hot``
    (``heavy_hitters`` of stored counts) the words that most rows have meet it
    in a broadcast of their few rows.

    positions: (row_key, pos, word) or ``word_counts``; coef: (<key>, coef)
    keyed by word, as ``word_log_odds`` gives it.
    ``presence``: the model sees word presence (counts otherwise).
    Returns (row_key, word, n, first_pos, score)."""
    coef = coef.select(F.col(key).alias("word"), "coef")
    counts = word_counts(positions).select("row_key", "word", "n", "first_pos")
    j = counts.join(coef, "word", "left") if hot is None else split_join(counts, coef, ["word"], hot=hot)
    weight = F.coalesce(F.col("coef"), F.lit(0.0))
    # presence features: a present word contributes its weight once
    score = weight if presence else F.col("n") * weight
    return j.select("row_key", "word", "n", "first_pos", score.alias("score"))


def word_log_odds(positions: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """A closed-form linear text model: smoothed log-ratio of a word's rate
    in TRUE vs FALSE training statements.  (word, n_true, n_false, coef)."""
    # count per (row, word) first: a long document or a common word is
    # pre-aggregated before it meets the labels
    per_row = word_counts(positions).select("row_key", "word", F.col("n").alias("_n"))
    j = per_row.join(labels.select("row_key", "y"), "row_key")
    c = j.groupBy("word").agg((F.sum(F.col("y") * F.col("_n"))).cast("bigint").alias("n_true"),
                              (F.sum((1 - F.col("y")) * F.col("_n"))).cast("bigint").alias("n_false"))
    tot = c.agg(F.sum("n_true").alias("tp"), F.sum("n_false").alias("tn"), F.count(F.lit(1)).alias("v"))
    c = c.withColumn("_t", tot.select(F.struct("tp", "tn", "v")).scalar())  # one scalar subquery
    tp, tn, v = F.col("_t.tp"), F.col("_t.tn"), F.col("_t.v")
    a = F.lit(float(alpha))
    coef = (F.log((F.col("n_true") + a) / (tp + a * v)) - F.log((F.col("n_false") + a) / (tn + a * v)))
    return c.withColumn("coef", coef).drop("_t")


def numeric_attribution(df: DataFrame, weights: dict, baseline_mean: dict, noise_mean: dict | None = None,
                        names=None) -> DataFrame:
    """Expected-gradients attribution of the numeric features for a model
    that is linear in them: w_i * (x_i + mean noise_i - mean baseline_i).

    The baseline / noise sample table is small and fixed, so only its means
    enter the plan (as literals): no join with the sample table."""
    from credo.constants import FEATURE_NAMES

    names = names or FEATURE_NAMES
    noise_mean = noise_mean or {n: 0.0 for n in names}

    def lit(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    out = [F.col("row_key")]
    for n in names:
        out.append((F.lit(float(weights[n])) * (F.col(n) + lit(noise_mean[n]) - lit(baseline_mean[n])))
                   .alias(f"a_{n}"))
    return df.select(*out)


def baseline_offsets(n: int = 50, sd: float = 0.05, noise_sd: float = 0.09, seed: int = 42):
    """Mean baseline offset and mean input noise per feature, from a fixed
    seed: the sample table (n x 5) is a bounded parameter, only its means
    matter for a model linear in the numeric features."""
    import numpy as np

    from credo.constants import FEATURE_NAMES

    rng = np.random.default_rng(seed)
    offs = rng.normal(0.0, sd, size=(n, 5)).mean(axis=0)
    noise = rng.normal(0.0, noise_sd, size=(n, 5)).mean(axis=0)
    return dict(zip(FEATURE_NAMES, offs.tolist())), dict(zip(FEATURE_NAMES, noise.tolist()))


def neutral_point(cs_default: float, default_cred) -> dict:
    """The neutral input: unknown speaker, average credibility, mean length."""
    return {"cs_ratio": cs_default, "speaker_cred": default_cred, "affil_cred": default_cred,
            "ctx_cred": default_cred, "len_norm": 0.0}


def baseline_samples(cs_default: float, default_cred: float, n: int = 50, sd: float = 0.05,
                     noise_sd: float = 0.09, seed: int = 42):
    """(mean baseline, mean noise) per feature for a neutral point."""
    offs, noise = baseline_offsets(n, sd, noise_sd, seed)
    neutral = neutral_point(cs_default, default_cred)
    return {k: neutral[k] + offs[k] for k in offs}, noise


def kept_words(key: str, words: list[str], n_samples: int) -> np.ndarray:
    """Which words each sample keeps, as 0 / 1 (n_samples, words).

    Sample 0 keeps every word; in the others a word stays where the low bit of
    the first byte of md5(row|sample|word) is set; nulls are left out of that text.
    """
    start = "" if key is None else f"{key}|"
    texts = [b"" if w is None else b"|" + w.encode() for w in words]
    md5, out = hashlib.md5, np.ones((n_samples, len(words)))
    for s in range(1, n_samples):
        head = f"{start}{s}".encode()
        out[s] = [md5(head + t, usedforsecurity=False).digest()[0] & 1 for t in texts]
    return out


def removal_scores(n_samples: int, kernel_width: float):
    """A UDF of (row_key, ws, base): array (pos, word, score) of the words ``ws`` (word_pos, word, c), in Arrow batches."""

    @F.arrow_udf("array<struct<pos:bigint,word:string,score:double>>")
    def score(keys: pa.Array, rows: pa.Array, bases: pa.Array) -> pa.Array:
        flat, sizes = rows.flatten(), np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
        ends = np.cumsum(sizes)
        pos, words = pc.struct_field(flat, "word_pos"), pc.struct_field(flat, "word")
        parts = np.asarray(pc.struct_field(flat, "c"))
        names, found = words.to_pylist(), np.zeros(len(flat))
        for key, base, end, size in zip(keys.to_pylist(), bases.to_pylist(), ends.tolist(), sizes.tolist()):
            if base is None or not size:
                continue  # no probability, so no word moves it
            keep = kept_words(key, names[end - size:end], n_samples)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(base + keep @ parts[end - size:end])))
            wt = np.exp(-((1 - keep.mean(axis=1)) ** 2) / kernel_width ** 2)
            drop = 1 - keep
            gone = wt @ drop
            # sample 0 keeps every word; a word that no sample drops has no second mean
            found[end - size:end] = (wt * p) @ keep / (wt @ keep) - np.divide((wt * p) @ drop, gone, out=np.zeros(size), where=gone > 0)
        out = pa.StructArray.from_arrays([pos, words, pa.array(found)], names=["pos", "word", "score"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), out)

    return score


def perturbation_attribution(positions: DataFrame, base_score: DataFrame, coef: DataFrame,
                             n_samples: int = 50, top: int = 10, kernel_width: float = 0.25, hot: list[int] | None = None) -> DataFrame:
    """Word importance by random word removal, as one batch job.

    Bag of words: for every (row, sample, word) the word -- all its
    occurrences -- is kept when the low bit of md5(row|sample|word) is set;
    sample 0 keeps everything.  Each variant is scored with the linear text
    model plus the row's frozen non-text logit; a word's importance is the
    kernel-weighted mean probability of the variants that keep it minus that
    of the variants that drop it (kernel exp(-(1 - kept share)^2 / width^2)).
    Rows: samples x distinct words per statement (linear in its length; no
    word pairs).

    All samples of a statement are drawn and scored inside its row, over the
    array of its distinct words: the words are gathered once, and nothing is
    shuffled by sample.  Rows come in Arrow batches; the samples of one are a
    small matrix.

    positions: (row_key, pos, word) or ``word_counts``; base_score: (row_key,
    base); coef: (word, coef); ``hot`` as in ``text_attribution``.
    Returns the ``top`` words per row: (row_key, rank, word, score)."""
    words = word_counts(positions).select("row_key", "word", "n", F.col("first_pos").alias("word_pos"))
    coef = coef.select("word", "coef")
    words = words.join(coef, "word", "left") if hot is None else split_join(words, coef, ["word"], hot=hot)
    words = words.withColumn("_c", F.col("n") * F.coalesce(F.col("coef"), F.lit(0.0)))
    rows = words.select("row_key", F.struct("word_pos", "word", F.col("_c").alias("c")).alias("w"))
    rows = rows.groupBy("row_key").agg(F.sort_array(F.collect_list("w")).alias("ws")).join(base_score, "row_key")
    rows = rows.select("row_key", removal_scores(n_samples, kernel_width)("row_key", "ws", "base").alias("scored"))
    # rank on the value rounded to 1e-9 so float summation order cannot reorder ties
    order = F.transform("scored", lambda x: F.struct((-F.abs(F.round(x["score"], 9))).alias("k"), x["pos"].alias("pos"),
                                                     x["word"].alias("word"), x["score"].alias("score")))
    best = rows.select("row_key", F.posexplode(F.slice(F.sort_array(order), 1, top)).alias("i", "x"))
    return best.select("row_key", (F.col("i") + 1).alias("rank"), "x.word", "x.score")


def route_attributions(primary: DataFrame, delta: DataFrame, fallback) -> DataFrame:
    """Keep the primary attributions of rows whose completeness check passed
    and take the fallback explainer's rows for the others (a filter on each
    side and a union -- the fallback only ever sees the routed rows).

    primary: (row_key, rank, word, score); delta: completeness_delta output;
    fallback: callable(routed_keys DataFrame) -> (row_key, rank, word, score)."""
    ok = delta.filter(F.col("use_primary")).select("row_key")
    poor = delta.filter(~F.col("use_primary")).select("row_key")
    kept = primary.join(ok, "row_key", "left_semi").withColumn("method", F.lit("primary"))
    other = fallback(poor).withColumn("method", F.lit("fallback"))
    return kept.unionByName(other)
