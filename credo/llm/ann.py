"""Nearest neighbours by randomly rotated one-bit codes.

The index holds, for each vector, the signs of its rotated offset from a
centre, packed into bits, and two correction scalars: the offset's length and
the inner product of the unit offset with its code.  A query estimates all
inner products from the bits; the scalars also bound the error, with a chance
of failure that falls off like a Gaussian's tail in ``EPSILON``.  Vectors
whose lower bound is above the k-th smallest upper bound can't be among the k
nearest; the others are ranked again by exact distances, in double precision.

The centre is the mean of at most ``CENTRE_ROWS`` vectors (those with the
lowest hash of their id); any centre gives right bounds, so it only affects
speed.  All rows are indexed.  Vectors that are null, zero or hold null or
non-finite components take no part, nor do rows without an id or with another
dimension than the most common one (of equally common ones the largest).
Queries and vectors meet block by block; each block has a bounded size.  Of
rows with one id that is queried, the first vector by value is the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credo.llm.common import stored

CENTRE_ROWS = 4096
#: Vectors of an index row, and queries of a block.
CHUNK, BLOCK = 4096, 512
EPSILON = 4.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id long and v array<double> of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))
    best = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (best["d"] if best else 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, offset lengths, and inner products of unit offsets with their codes."""
    offset = (vectors - centre) @ turn
    length = np.sqrt((offset * offset).sum(axis=1))
    bits = offset > 0
    agree = np.abs(offset).sum(axis=1) / np.sqrt(offset.shape[1])
    return np.packbits(bits, axis=1), length, np.divide(agree, length, out=np.ones_like(length), where=length > 0)


def bounds(bits: np.ndarray, length: np.ndarray, agree: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, a row for each (rotated, centred) query."""
    dim = queries.shape[1]
    size = np.sqrt((queries * queries).sum(axis=1))[:, None]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1
    inner = (queries @ signs.T) / np.sqrt(dim) / agree
    slack = size * np.sqrt(np.maximum(1 - agree**2, 0)) / agree * EPSILON / np.sqrt(max(dim - 1, 1))
    base = size**2 + length**2
    return base - 2 * length * (inner + slack), base - 2 * length * (inner - slack)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact distances; components are added in order, so that the sums don't depend on the batch."""
    total = np.zeros(len(vectors))
    for i in range(len(query)):
        total += (vectors[:, i] - query[i]) ** 2
    return np.sqrt(total)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The stored index (rows of up to ``CHUNK`` vectors), its centre and its rotation."""
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(CENTRE_ROWS).select("v").collect()
    dim = len(sample[0]["v"]) if sample else 1
    centre = np.mean([r["v"] for r in sample], axis=0) if sample else np.zeros(dim)
    turn = rotation(dim, seed)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(0).to_numpy()
                v = part.column(1).flatten().to_numpy().reshape(-1, dim)
                values = [ids.astype("<i8"), v.astype("<f8"), *encode(v, centre, turn)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in values], names=INDEX)

    index = rows.mapInArrow(chunks, ", ".join(f"{n} binary" for n in INDEX))
    return stored(index.withColumn("chunk", F.monotonically_increasing_id()), "ann-index"), centre, turn


INDEX = ["ids", "vectors", "bits", "length", "agree"]


def search(index: DataFrame, centre: np.ndarray, turn: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and distance of the ``k`` nearest other vectors of each query (id, v)."""
    dim = len(centre)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    packed = queries.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("queries"))
    # each index row meets each block of queries once
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
    pairs = pairs.select(*INDEX, F.col("queries.id").alias("query_ids"), F.flatten("queries.v").alias("query_vectors"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                raw = [batch.column(i)[n].as_buffer() for i in range(len(INDEX))]
                ids = np.frombuffer(raw[0], dtype="<i8")
                v = np.frombuffer(raw[1], dtype="<f8").reshape(-1, dim)
                bits = np.frombuffer(raw[2], dtype=np.uint8).reshape(len(ids), -1)
                query_ids = batch.column(5)[n].values.to_numpy()
                q = batch.column(6)[n].values.to_numpy().reshape(-1, dim)
                low, high = bounds(bits, np.frombuffer(raw[3]), np.frombuffer(raw[4]), (q - centre) @ turn)
                own = query_ids[:, None] == ids
                low[own] = high[own] = np.inf
                found: list[list[np.ndarray]] = [[], [], []]
                limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
                for i, query in enumerate(query_ids):
                    at = np.flatnonzero((low[i] <= limit[i]) & ~own[i])
                    away = distances(v[at], q[i])
                    best = np.lexsort((ids[at], away))[:k]
                    for out, x in zip(found, (np.full(len(best), query), ids[at][best], away[best])):
                        out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "id", "distance"])

    top = Window.partitionBy("query_id").orderBy("distance", "id")
    found = pairs.mapInArrow(near, "query_id long, id long, distance double")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
