"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_HELD: dict[str, Any] = {}


def held(owner: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers for ``owner``.

    Workers outlive tasks and serve one operator after the other; only the
    last one's memory is kept.
    """
    if _HELD.get("owner") != owner:
        _HELD.clear()
        give_back()
        _HELD.update(owner=owner, value=make())
    return _HELD["value"]


def give_back() -> None:
    """Return freed memory to the system; an idle worker otherwise keeps what its largest batch took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(values: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive strings that have up to ``size`` bytes together; a longer one is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, stop
        at = stop


def text_or_empty(col: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
