"""Attributions of the two-layer head, whose ReLU makes gradients depend on the input.

The head is ``f = b2 + w2 . relu(W1 x + b1)`` over the fused input (sentence
vector, ``tanh(cs_a * cs_ratio + cs_b)``, four metadata features).

Text: the sentence vector that the head is explained on is the mean of its
words' vectors, and a word's vector is the mean sentence vector of the
training statements that have it (zeros for other words).  The first layer is
linear, so a word is carried as its share of the hidden layer, ``W1_text . e``:
a few numbers instead of a vector.  Integrated gradients run along the
straight path from no text to the text, other inputs frozen; on it the hidden
layer is ``c + t m``, and its gates at the quadrature's nodes are all that the
integral needs.  A rule with few nodes misses where a gate opens, so the sum of
the contributions differs from ``f(text) - f(no text)``: that difference is the
completeness delta, and rows where it is POOR go to the second explainer,
which removes words and scores what is left.

Numeric features: expected gradients over a fixed, seeded table of baselines
near the neutral input, input noise and path positions, in Arrow batches.

Empty statements have no words, no contributions and a delta of 0; null vectors
count as zeros.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.constants import DELTA_ACCEPTABLE, DELTA_EXCELLENT, FEATURE_NAMES, TOP_WORDS
from credo.operators.attribution import kept_words
from credo.operators.skew import heavy_hitters, split_join

#: Numeric inputs after the sentence vector.
TAIL = 5


def gauss_legendre(steps: int) -> tuple[list[float], list[float]]:
    """Nodes and weights of the quadrature on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(steps)
    return ((x + 1) / 2).tolist(), (w / 2).tolist()


def midpoints(steps: int) -> tuple[list[float], list[float]]:
    return [(k + 0.5) / steps for k in range(steps)], [1 / steps] * steps


RULES = {"gausslegendre": gauss_legendre, "midpoint": midpoints}


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _dot(weights, vector: Column) -> Column:
    """The sum of weights times a vector's elements, from the first to the last."""
    products = F.zip_with(F.array(*(F.lit(float(w)) for w in weights)), vector, lambda a, b: a * F.coalesce(b, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def frozen_hidden(df: DataFrame, head: dict, cs_a: float, cs_b: float) -> Column:
    """Array: the hidden layer without text, from the numeric features."""
    tail = [F.tanh(F.lit(float(cs_a)) * F.col("cs_ratio") + F.lit(float(cs_b))), *(F.col(n) for n in FEATURE_NAMES[1:])]
    return F.array(*(_total([F.lit(float(b)), *(F.lit(float(w)) * x for w, x in zip(row[-TAIL:], tail))])
                     for row, b in zip(np.asarray(head["W1"]), head["b1"])))


def text_hidden(head: dict, vector: str = "text_vec") -> Column:
    """Array: what a sentence vector adds to the hidden layer."""
    v = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    return F.array(*(_dot(row[:-TAIL], v) for row in np.asarray(head["W1"])))


def word_hidden(positions: DataFrame, rows: DataFrame, head: dict) -> DataFrame:
    """(word, u): each word's share of the hidden layer.

    positions: (row_key, pos, word); rows: (row_key, text_vec) of the training
    statements.  A word counts once a statement; a statement is projected
    before it meets its words, and sums are partial in each task.
    """
    hidden = rows.select("row_key", text_hidden(head).alias("_p"))
    words = positions.select("row_key", "word").distinct().join(hidden, "row_key")
    n = len(head["b1"])
    means = words.groupBy("word").agg(*(F.avg(F.col("_p")[j]).alias(f"_{j}") for j in range(n)))
    return means.select("word", F.array(*(F.coalesce(f"_{j}", F.lit(0.0)) for j in range(n))).alias("u"))


def gathered(rows: DataFrame, positions: DataFrame, words: DataFrame, head: dict, cs_a: float, cs_b: float) -> DataFrame:
    """One row a statement: row_key, c (hidden layer without text), m (what the text adds), n (its words) and ws.

    ws: array of (pos, word, n, u) of the distinct words, by first position.
    Occurrences are counted before the words meet their vectors, and hot words
    meet them in a broadcast.
    """
    size = len(head["b1"])
    zeros = F.array(*[F.lit(0.0)] * size)
    counts = positions.groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    hot = heavy_hitters(counts, ["word"])
    known = split_join(counts, words, ["word"], hot=hot).withColumn("u", F.coalesce("u", zeros))
    ws = known.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "n", "u"))).alias("ws"))
    out = rows.select("row_key", frozen_hidden(rows, head, cs_a, cs_b).alias("c")).join(ws, "row_key", "left")
    out = out.withColumn("ws", F.coalesce("ws", F.array().cast(ws.schema["ws"].dataType)))
    out = out.withColumn("n", F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w["n"]))

    def mean(j: int) -> Column:
        total = F.aggregate("ws", F.lit(0.0), lambda s, w: s + w["n"] * w["u"][j])
        return F.coalesce(F.try_divide(total, F.col("n").cast("double")), F.lit(0.0))

    return out.withColumn("m", F.array(*map(mean, range(size))))


def head_prob(head: dict) -> Column:
    """The head's probability for ``gathered`` rows."""
    logit = _total([F.lit(float(head["b2"])), *(F.lit(float(w)) * F.greatest(F.col("c")[j] + F.col("m")[j], F.lit(0.0))
                                                for j, w in enumerate(head["w2"]))])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def gates(steps: int, rule: str, size: int) -> Column:
    """Array: the quadrature's mean of each hidden unit's gate along the path."""
    nodes, weights = RULES[rule](steps)
    path = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in zip(nodes, weights)))
    c, m = F.col("c"), F.col("m")

    def gate(j: int) -> Column:
        return F.aggregate(path, F.lit(0.0), lambda s, x: s + F.when(c[j] + x["t"] * m[j] > 0, x["w"]).otherwise(0.0))

    return F.array(*map(gate, range(size)))


def with_path(rows: DataFrame, head: dict, steps: int = 20, rule: str = "gausslegendre") -> DataFrame:
    """``gathered`` rows with g (gates), delta, quality and use_primary."""
    w2, size = [float(w) for w in head["w2"]], len(head["b1"])
    out = rows.withColumn("g", gates(steps, rule, size))
    c, m, g = F.col("c"), F.col("m"), F.col("g")
    relu = lambda x: F.greatest(x, F.lit(0.0))
    gap = _total(F.lit(w) * (m[j] * g[j] - (relu(c[j] + m[j]) - relu(c[j]))) for j, w in enumerate(w2))
    # bands are decided at 1e-9, so float summation order cannot flip them
    out = out.withColumn("delta", F.abs(gap)).withColumn("_band", F.round("delta", 9))
    quality = (F.when(F.col("_band") < DELTA_EXCELLENT, "EXCELLENT").when(F.col("_band") < DELTA_ACCEPTABLE, "ACCEPTABLE").otherwise("POOR"))
    return out.withColumns({"quality": quality, "use_primary": F.col("_band") < DELTA_ACCEPTABLE}).drop("_band")


def path_contributions(head: dict) -> Column:
    """Array (pos, word, score) of ``with_path`` rows: each word's integrated gradient."""
    w2 = [float(w) for w in head["w2"]]
    n = F.col("n").cast("double")
    return F.transform("ws", lambda w: F.struct(w["pos"].alias("pos"), w["word"].alias("word"), (
        w["n"] * _total(F.lit(v) * w["u"][j] * F.col("g")[j] for j, v in enumerate(w2)) / n).alias("score")))


def removal_contributions(head: dict, n_samples: int = 50, kernel_width: float = 0.25) -> Column:
    """Array (pos, word, score): each word's importance by random removal.

    Sample 0 keeps every word; in the others a word stays where the low bit of
    the first byte of md5(row|sample|word) is set.  What is left is scored by the head,
    and a word's score is the kernel-weighted mean probability of the samples
    that keep it minus that of those that drop it.
    """
    w2, b2 = np.asarray(head["w2"], dtype=np.float64), float(head["b2"])
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("word", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<pos:bigint,word:string,score:double>>")
    def score(keys: pa.Array, rows: pa.Array, frozen: pa.Array) -> pa.Array:
        out = []
        for key, ws, c in zip(keys.to_pylist(), rows.to_pylist(), frozen.to_pylist()):
            if not ws:
                out.append([])
                continue
            keep = kept_words(key, [w["word"] for w in ws], n_samples)
            n = keep * np.array([w["n"] for w in ws], dtype=np.float64)
            left = n.sum(axis=1, keepdims=True)
            text = np.divide(n @ np.array([w["u"] for w in ws]), left, out=np.zeros((n_samples, len(w2))), where=left > 0)
            p = 1 / (1 + np.exp(-(np.maximum(np.array(c) + text, 0) @ w2 + b2)))
            wt = np.exp(-((1 - keep.mean(axis=1)) ** 2) / kernel_width ** 2)
            mean = lambda k: np.divide((wt * p) @ k, wt @ k, out=np.zeros(len(ws)), where=wt @ k > 0)
            out.append([{"pos": w["pos"], "word": w["word"], "score": float(x)} for w, x in zip(ws, mean(keep) - mean(1 - keep))])
        return pa.array(out, kind)

    return score("row_key", "ws", "c")


def top_of(scored: str, k: int = TOP_WORDS) -> Column:
    """Array (word, score) of the ``k`` largest |score|; ties (at 1e-9) keep text order."""
    order = F.transform(scored, lambda x: F.struct((-F.abs(F.round(x["score"], 9))).alias("k"), x["pos"].alias("pos"),
                                                   x["word"].alias("word"), x["score"].alias("score")))
    return F.transform(F.slice(F.sort_array(order), 1, k), lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score")))


def routed(rows: DataFrame, head: dict, k: int = TOP_WORDS, n_samples: int = 50) -> DataFrame:
    """row_key, delta, quality, method and top (array of word, score): the explanation of each ``with_path`` row.

    Rows with an acceptable delta keep their integrated gradients
    (``gradients``); only the others meet the explainer by removal
    (``removal``).  ``rows`` is read once a branch: give a stored table.
    """
    cols = ("row_key", "delta", "quality")
    good = rows.filter("use_primary").withColumn("scored", path_contributions(head))
    poor = rows.filter("not use_primary").withColumn("scored", removal_contributions(head, n_samples))
    good = good.select(*cols, F.lit("gradients").alias("method"), top_of("scored", k).alias("top"))
    return good.unionByName(poor.select(*cols, F.lit("removal").alias("method"), top_of("scored", k).alias("top")))


def sample_table(n: int = 50, sd: float = 0.05, noise_sd: float = 0.09, seed: int = 42) -> dict[str, np.ndarray]:
    """Baseline offsets and input noise (n x 5) and path positions (n), from a fixed seed: a bounded parameter."""
    rng = np.random.default_rng(seed)
    return {"offset": rng.normal(0.0, sd, (n, TAIL)), "noise": rng.normal(0.0, noise_sd, (n, TAIL)), "at": rng.uniform(0.0, 1.0, n)}


def expected_gradients(df: DataFrame, head: dict, cs_a: float, cs_b: float, neutral: dict[str, Column], samples: dict | None = None,
                       text: Column | None = None, keep: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """row_key and a_<feature>: the head's expected gradients over the five numeric features, text frozen.

    For each sample: the gradient at the point ``at`` of the way from the
    baseline (neutral + offset) to the noisy input, times their difference;
    averaged.  The gradient of tanh and the gates of the ReLU are those of
    that point.  ``text`` is what the frozen text adds to the hidden layer
    (that of text_vec by default); columns named in ``keep`` pass through.
    """
    samples = samples or sample_table()
    w1 = np.asarray(head["W1"], dtype=np.float64)
    wc, wm = w1[:, -TAIL], w1[:, 1 - TAIL:]
    b1, w2 = np.asarray(head["b1"], dtype=np.float64), np.asarray(head["w2"], dtype=np.float64)
    offset, noise, at = (np.asarray(samples[k]) for k in ("offset", "noise", "at"))

    @F.arrow_udf("array<double>")
    def attribute(texts: pa.Array, inputs: pa.Array, neutrals: pa.Array) -> pa.Array:
        frozen, x, base = (np.array(a.to_pylist(), dtype=np.float64).reshape(len(a), -1) for a in (texts, inputs, neutrals))
        frozen, total = frozen + b1, np.zeros_like(x)
        for o, e, t in zip(offset, noise, at):
            gap = (x + e) - (base + o)
            point = base + o + t * gap
            cs = np.tanh(cs_a * point[:, 0] + cs_b)
            gate = (frozen + cs[:, None] * wc + point[:, 1:] @ wm.T > 0) * w2
            slope = np.column_stack(((gate @ wc) * cs_a * (1 - cs ** 2), gate @ wm))
            total += slope * gap
        return pa.array((total / len(at)).tolist(), pa.list_(pa.float64()))

    found = attribute(text_hidden(head) if text is None else text, F.array(*(F.col(n) for n in FEATURE_NAMES)),
                      F.array(*(neutral[n] for n in FEATURE_NAMES)))
    out = df.select(*keep, found.alias("_a"))
    return out.select(*keep, *(F.col("_a")[i].alias(f"a_{n}") for i, n in enumerate(FEATURE_NAMES)))
