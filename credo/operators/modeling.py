"""Text features, feature fusion, training and batch scoring.

Training is Spark ML: hashed term presence over the whole cleaned text (every
word takes part, at any vocabulary size) + the five numeric features -> ``VectorAssembler`` -> class-weighted
``LogisticRegression`` (TRUE rows weigh n_false / n_true, as a positive-class
weight in a binary cross-entropy).  The model is linear in every input, so
integrated-gradient attributions are exact (weight x value; a present term
contributes its weight once, through its first word if words share it).

``head_score`` evaluates a given two-layer ReLU head over fused feature
arrays with NumPy in a batch predictor, which loads the weights once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from credo.constants import FEATURE_NAMES, MAX_LEN
from credo.functions.text import word_tokens
from credo.session import scratch_dir

#: Terms where no distinct count of the words is taken; a dense weight vector of this size is all a fit or a score holds.
NUM_FEATURES = 1 << 16
#: Most terms that a distinct count leads to (32 MB of weights).
MOST_TERMS = 1 << 22
#: Optimizer steps; the tolerance usually ends a fit before.
MAX_ITER = 100
#: Length of a sentence vector.
EMBEDDING_DIM = 64
NUMERIC = ["cs_ratio", "speaker_cred", "affil_cred", "ctx_cred", "len_norm"]


def tokenize_truncate(df: DataFrame, max_len: int = MAX_LEN, text: str = "statement",
                      clean: bool = True) -> DataFrame:
    """Word tokens of the whole (cleaned, lower-cased) text, plus the model
    input cut to ``max_len`` positions including the two special tokens.
    Padding is not materialised: position p is real iff p <= n_tokens."""
    words = word_tokens(text, clean)
    return (df.withColumn("_words", words)
              .withColumn("n_words", F.size("_words").cast("int"))
              .withColumn("tokens", F.slice("_words", 1, max_len - 2))
              .withColumn("n_tokens", F.size("tokens").cast("int"))
              .drop("_words"))


def with_words(df: DataFrame, text: str = "statement", clean: bool = True) -> DataFrame:
    return df.withColumn("words", word_tokens(text, clean))


def text_features(num_features: int = NUM_FEATURES, words: str = "words") -> HashingTF:
    """Hashed term presence (sparse 0/1 vector ``text_tf``)."""
    return HashingTF(inputCol=words, outputCol="text_tf", numFeatures=num_features, binary=True)


def join_embeddings(df: DataFrame, embeddings: DataFrame, key: str = "row_key", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Attach a precomputed text vector per statement (equi-join on key);
    statements without one stay, with the zero vector."""
    out = df.join(embeddings.select(key, "text_vec"), key, "left")
    return out.withColumn("text_vec", F.coalesce(F.col("text_vec").cast("array<double>"), F.array_repeat(F.lit(0.0), dim)))


def fuse_features(df: DataFrame, cs_a: float, cs_b: float, text_vec: str = "text_vec") -> DataFrame:
    """text vector ++ [tanh(a * cs_ratio + b)] ++ four metadata features."""
    tail = F.array(F.tanh(F.lit(float(cs_a)) * F.col("cs_ratio") + F.lit(float(cs_b))),
                   F.col("speaker_cred"), F.col("affil_cred"), F.col("ctx_cred"), F.col("len_norm"))
    return df.withColumn("fused", F.concat(F.col(text_vec).cast("array<double>"), tail))


def head_weights(dim: int, hidden: int, seed: int = 7) -> dict:
    """A fixed head (parameters from a seed), for tests and examples."""
    rng = np.random.default_rng(seed)
    return {"W1": rng.normal(0, 0.2, size=(hidden, dim)).round(6), "b1": rng.normal(0, 0.1, size=hidden).round(6),
            "w2": rng.normal(0, 0.5, size=hidden).round(6), "b2": float(np.round(rng.normal(0, 0.1), 6))}


def head_score(df: DataFrame, weights: dict, fused: str = "fused", batch_size: int = 1024) -> DataFrame:
    """logit = w2 . relu(W1 x + b1) + b2 and prob = sigmoid(logit).

    A batch predictor: each Python worker loads the weights once and scores
    ``batch_size`` rows at a time, whatever the Arrow batches are."""
    from pyspark.ml.functions import predict_batch_udf

    given = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}

    def load():
        def predict(x: np.ndarray) -> np.ndarray:
            hidden = np.maximum(0.0, x.astype(np.float64) @ given["W1"].T + given["b1"])
            return hidden @ given["w2"] + float(given["b2"])
        return predict

    logit = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[given["W1"].shape[1]]])
    out = df.withColumn("logit", logit(F.col(fused)))
    return out.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))


def class_weights(train: DataFrame, y: str = "y") -> DataFrame:
    """Add weight ``w``: n_false / n_true for TRUE rows, 1 for FALSE rows."""
    pw = train.agg(F.try_divide(F.sum(1 - F.col(y)).cast("double"), F.sum(F.col(y)).cast("double")).alias("pw"))
    return train.withColumn("w", F.when(F.col(y) == 1, F.coalesce(pw.select("pw").scalar(), F.lit(1.0)))
                            .otherwise(F.lit(1.0)))


def front_stages(text, num_features: int) -> list:
    """Stages that need no fit: the text's terms, and all inputs in one vector ``features``.

    text: True (hashed term presence of ``words``), 'embedding' (the
    ``text_emb`` vector of a precomputed sentence embedding) or False."""
    stages, inputs = [], list(NUMERIC)
    if text == "embedding":
        inputs.append("text_emb")
    elif text:
        # presence, not counts: long texts would otherwise dominate (validated on f1)
        stages.append(text_features(num_features))
        inputs.append("text_tf")
    # feature_table never yields NULL features; embeddings carry no size
    # metadata, so that mode validates strictly instead of keeping NaNs
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error" if text == "embedding" else "keep")]


#: Stands for the attributes of all terms.
ONE_ATTRIBUTE = {"ml_attr": {"num_attrs": 1, "attrs": {"numeric": [{"idx": 0}]}}}


def through(stages, df: DataFrame) -> DataFrame:
    """``df`` through fitted stages, one by one.

    ``VectorAssembler`` describes each input element by an attribute in the
    column's metadata; millions of terms would make gigabytes of them on the
    driver, so it is shown one attribute for all.
    """
    for stage in stages:
        df = stage.transform(df)
        if isinstance(stage, HashingTF):
            df = df.withMetadata(stage.getOutputCol(), ONE_ATTRIBUTE)
    return df


def classifier(reg: float = 0.01, max_iter: int = MAX_ITER, tol: float = 1e-6) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=reg,
                              elasticNetParam=0.0, maxIter=max_iter, tol=tol, standardization=True,
                              # a block costs a pass over all terms: few large ones
                              maxBlockSizeInMB=64.0)


def linear_model(spark, numeric: dict[str, float], intercept: float) -> PipelineModel:
    """A model of the numeric features with given weights (made elsewhere, or fixed for a check)."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors

    sc = spark.sparkContext
    weights = _py2java(sc, Vectors.dense([float(numeric[n]) for n in NUMERIC]))
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("given", weights, float(intercept))
    model = LogisticRegressionModel(made).setFeaturesCol("features")
    return PipelineModel([*front_stages(False, 0), model])


def sized_terms(words: DataFrame, column: str = "words", most: int = MOST_TERMS) -> int:
    """Terms for the words of a table: the power of two above twice their number, ``most`` at most.

    One pass with a distinct-count sketch.  With a load below a half, most words
    have a term of their own."""
    n = words.select(F.explode(column).alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    return max(1 << 10, min(most, 1 << max(0, 2 * n - 1).bit_length()))


def with_embedding_vector(df: DataFrame, col: str = "text_vec") -> DataFrame:
    """A precomputed array<float> text vector as an ML vector ``text_emb``."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("text_emb", array_to_vector(F.col(col).cast("array<double>")))


def with_text(df: DataFrame, text) -> DataFrame:
    """``df`` with the column that the text stage reads."""
    if text == "embedding":
        return with_embedding_vector(df) if "text_emb" not in df.columns else df
    return with_words(df) if text and "words" not in df.columns else df


def fit_candidates(train: DataFrame, regs, text=True, max_iter: int = MAX_ITER, tol: float = 1e-6,
                   num_features: int | None = None) -> list[PipelineModel]:
    """One model for each regularization, fitted on one stored block of assembled rows.

    The words are hashed and the rows weighted once, whatever the number of
    candidates.  ``num_features`` is sized from a
    distinct count of the words if not given.
    """
    spark = train.sparkSession
    rows = with_text(train, text)
    if num_features is None:
        num_features = sized_terms(rows) if text is True else NUM_FEATURES
    stages = front_stages(text, num_features)
    block = through(stages, class_weights(rows)).select(F.col("y").cast("double").alias("y"), "w", "features")
    block, columns = used_columns(block) if text is True else (block, None)
    lr = classifier(max_iter=max_iter, tol=tol)
    # the optimizer makes many passes: a fit keeps its blocks (memory, spilling to disk).
    # One after the other, as the driver holds some thirty vectors a fit
    size = len(NUMERIC) + num_features
    if columns is None:
        block = block.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = (lr.copy({lr.regParam: float(r)}).fit(block) for r in regs)
        return [without_summary(spark, PipelineModel([*stages, dense_model(spark, fit, columns, size)])) for fit in fits]
    finally:
        block.unpersist()


def used_columns(block: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``block`` (y, w, features) with only the columns that some row has, written once; and those columns' numbers.

    A hashed vector is mostly empty terms, which a fit gives the weight 0 but
    holds in every vector on the driver and in every task's sums.
    """
    spark = block.sparkSession
    plain = block.select("y", "w", F.unwrap_udt("features").alias("v"))
    # a dense vector has all columns
    every = F.sequence(F.lit(0), F.size("v.values") - 1)
    used = plain.select(F.explode(F.when(F.col("v.type") == 1, every).otherwise(F.col("v.indices"))).alias("i")).distinct()
    columns = np.sort(used.toArrow().column("i").to_numpy().astype(np.int32))  # as many as the weights
    table = spark.sparkContext.broadcast(columns)
    folder = scratch_dir(spark, "vectors")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            v = batch.column("v")
            dense = np.asarray(pc.struct_field(v, "type")) == 1
            values, indices = pc.struct_field(v, "values"), pc.struct_field(v, "indices")
            size = np.asarray(pc.list_value_length(values))
            flat = np.empty(int(size.sum()), dtype=np.int32)
            of_dense = np.repeat(dense, size)
            starts = np.cumsum(size) - size
            flat[of_dense] = (np.arange(len(flat)) - np.repeat(starts, size))[of_dense]
            flat[~of_dense] = np.asarray(pc.list_flatten(indices.filter(pa.array(~dense))))
            found = np.searchsorted(known, flat).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            out = pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(batch), dtype=np.int8)), pa.array(np.full(len(batch), len(known), dtype=np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(found)), pa.ListArray.from_arrays(pa.array(ends), pc.list_flatten(values))],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("w"), out], names=["y", "w", "features"])

    kind = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    plain.mapInArrow(compact, f"y double, w double, features {kind}").write.parquet(folder)
    out = spark.read.schema(StructType([StructField("y", DoubleType()), StructField("w", DoubleType()), StructField("features", VectorUDT())])).parquet(folder)
    # few partial sums meet on the driver
    return out.coalesce(max(1, spark.sparkContext.defaultParallelism)), columns


def dense_model(spark, fitted, columns: np.ndarray | None, size: int):
    """The fitted classifier over all ``size`` columns, with dense weights.

    Spark stores weights that are mostly 0 as a sparse vector; a score then
    walks through all of them for each row.
    """
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors

    weights = fitted.coefficients.toArray()
    if columns is not None:
        every = np.zeros(size)
        every[columns] = weights
        weights = every
    sc = spark.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(fitted.uid, _py2java(sc, Vectors.dense(weights)), float(fitted.intercept))
    fitted._java_obj.copyValues(made, sc._jvm.org.apache.spark.ml.param.ParamMap.empty())
    return LogisticRegressionModel(made)


def without_summary(spark, model: PipelineModel) -> PipelineModel:
    """The model written and read back: a fitted one carries its training rows' plan and the session into every task."""
    path = scratch_dir(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def train_model(train: DataFrame, reg: float = 0.01, text=True, max_iter: int = MAX_ITER, tol: float = 1e-6,
                num_features: int | None = None) -> PipelineModel:
    """Fit the class-weighted classifier on the training split."""
    return fit_candidates(train, [reg], text, max_iter, tol, num_features)[0]


def candidate_scores(models: list[PipelineModel], df: DataFrame, text=True, y: str = "y") -> DataFrame:
    """(candidate, y, prob): the rows scored by every candidate in one pass over the shared front."""
    out = through(models[0].stages[:-1], with_text(df, text))
    names = []
    for i, model in enumerate(models):
        lr = model.stages[-1].copy()
        for part in ("Probability", "RawPrediction", "Prediction"):
            getattr(lr, f"set{part}Col")(f"_{part}_{i}")
        out = lr.transform(out)
        names.append(vector_to_array(f"_Probability_{i}")[1])
    return out.select(y, F.posexplode(F.array(*names)).alias("candidate", "prob"))


def batch_score(model: PipelineModel, df: DataFrame, text=True, keep=()) -> DataFrame:
    """Add ``prob`` = P(TRUE) (and ``logit``)."""
    s = through(model.stages, with_text(df, text))
    s = s.withColumn("prob", vector_to_array("probability")[1]) \
         .withColumn("logit", vector_to_array("rawPrediction")[1])
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction", "text_tf", "words", "text_emb")
            if c not in keep]
    return s.drop(*drop)


def coefficients(model: PipelineModel, text: bool = True):
    """(numeric weights dict, intercept, text weight array) of a fitted model."""
    lr = model.stages[-1]
    coef = lr.coefficients.toArray()
    numeric = dict(zip(FEATURE_NAMES, coef[:len(NUMERIC)].tolist()))
    text_w = coef[len(NUMERIC):] if text else np.zeros(0)
    return numeric, float(lr.intercept), text_w


def term_index(word: str, num_features: int) -> int:
    """The term of a word: 32-bit Murmur3 of its UTF-8 bytes with seed 42, as
    ``HashingTF`` uses it (its ``indexOf`` runs on the driver only)."""
    data, mask = word.encode(), 0xFFFFFFFF
    h = 42
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & mask
        h ^= ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        if i + 4 <= len(data):
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >= 1 << 31 else h) % num_features


def term_indices(words: pa.Array, num_features: int) -> np.ndarray:
    """``term_index`` of each of many words (none of them null), four bytes of all of them at a time."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), np.zeros(4, dtype=np.uint8)))
    sizes = np.diff(ends)
    longest = np.argsort(-sizes, kind="stable")
    starts, sizes = ends[:-1][longest], sizes[longest]
    turned = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    h = np.full(len(sizes), 42, dtype=np.uint32)
    for i in range(0, int(sizes[0]) if len(sizes) else 0, 4):
        n, whole = np.searchsorted(-sizes, [-i, -(i + 3)])  # words longer than i, and those with four bytes more
        k = np.zeros(n, dtype=np.uint32)
        for j in range(4):
            k |= np.where(sizes[:n] > i + j, data[starts[:n] + i + j], 0).astype(np.uint32) << np.uint32(8 * j)
        h[:n] ^= turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h[:whole] = turned(h[:whole], 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    out = np.empty(len(h), dtype=np.int64)
    out[longest] = h.view(np.int32).astype(np.int64) % num_features
    return out


def scores_of(words: pa.Array, weights: np.ndarray) -> pa.Array:
    """The weight of each word of the lists ``words``: of a list's words with one term the first has it, the others 0."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
    flat = pc.dictionary_encode(pc.list_flatten(words))
    terms = term_indices(flat.dictionary, len(weights))[np.asarray(flat.indices)] if len(flat) else np.zeros(0, dtype=np.int64)
    _, first = np.unique(np.repeat(np.arange(len(counts)), counts) * len(weights) + terms, return_index=True)
    values = np.zeros(len(terms))
    values[first] = weights[terms[first]]
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def word_scores(spark, model: PipelineModel):
    """The model weight of each of a row's distinct words, as a function of their column.  Of words that
    share a term the first has its weight and the others 0, so the scores sum
    to exactly the text's part of the logit."""
    _, _, weights = coefficients(model)
    if not len(weights):  # no term has a weight
        return lambda words: F.array_repeat(F.lit(0.0), F.coalesce(F.array_size(words), F.lit(0)))
    table = spark.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))  # NUM_FEATURES doubles

    @F.arrow_udf("array<double>")
    def scores(words: pa.Array) -> pa.Array:
        return scores_of(words, table.value)

    return scores


def select_by_validation(train: DataFrame, val: DataFrame, regs=(0.001, 0.01, 0.1), text=True, tol: float = 1e-6,
                         num_features: int | None = None, max_iter: int = MAX_ITER):
    """(index, model, balanced accuracy) of the candidate that ``select_best`` picks on ``val`` at 0.5.

    Without validation rows the first candidate is taken."""
    from credo.operators.sweep import select_best

    models = fit_candidates(train, regs, text, max_iter, tol, num_features)
    best = select_best(candidate_scores(models, val, text)).filter("is_best").first()  # one row
    if best is None or best["balanced_accuracy"] is None:
        return 0, models[0], -1.0
    return best["candidate"], models[best["candidate"]], best["balanced_accuracy"]
