"""Fill-in-the-middle: texts cut in three parts and put together in another order.

Cuts are drawn in code points, texts are UTF-8.  A sparse exception index
converts between the two: it records only the multibyte characters, by
position (in bytes and in code points) and by the bytes each takes beyond one.
``searchsorted`` finds how many of them lie before a cut, and their summed
excess is the distance between the two countings; stretches of ASCII need no
entry, so a plain English text has an empty index.  One index serves a whole
slice of an Arrow batch.

Each text is one of three forms: ``plain`` (left as it is), ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or ``spm`` (``<S>`` suffix
``<P>`` prefix ``<M>`` middle).  Texts that hold one of the marks stay plain, so
the marks of an output are its own and ``restore`` finds the text again.

Cuts and form depend on the id only; rows that share an id and text get the
same output.  A null text counts as empty and an empty text is plain; a null id
counts as the empty text in the draw.  Other columns are not touched, whatever
their names.  Work is map only: no row meets another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import fresh, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of the texts that are rearranged, and of those that are in the form ``spm``.
RATE, SPM_RATE = 90, 20
SEED = 1
#: Bytes of text indexed at once; a longer text is indexed alone.
SLICE_BYTES = 8 << 20

RESULT = "struct<form:string,n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>"


class ExceptionIndex:
    """Multibyte characters of UTF-8 bytes; every other byte is one code point."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        width = data[lead]
        excess = 1 + (width >= 0xE0).astype(np.int64) + (width >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(excess)))
        self.at_byte = lead
        self.at_char = lead - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (a cut lies between characters)."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return char + self.excess[np.searchsorted(self.at_char, char)]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``SLICE_BYTES`` of text, or of one row."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def rearranged(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text cut at two byte positions, in the order of ``form``."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def transform_batch(texts: pa.Array, draws: list[np.ndarray], rate: int, spm_rate: int) -> pa.RecordBatch:
    """form, n, prefix_chars, middle_chars and output of each text; ``draws`` are four numbers a row."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    forms, outputs = [], []
    n, first_cut, second_cut = (np.zeros(len(texts), np.int64) for _ in range(3))
    for start, stop in slices(offsets):
        base = offsets[start]
        index = ExceptionIndex(data[base:offsets[stop]])
        edges = offsets[start:stop + 1] - base
        at = index.chars(edges)
        size = np.diff(at)
        cuts = np.sort([draws[0][start:stop] % (size + 1), draws[1][start:stop] % (size + 1)], axis=0)
        n[start:stop], first_cut[start:stop], second_cut[start:stop] = size, *cuts
        first, second = (index.bytes(at[:-1] + c) - edges[:-1] for c in cuts)
        for i in range(start, stop):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            marked = any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))
            if not text or marked or draws[2][i] % 100 >= rate:
                forms.append("plain")
                outputs.append(text)
                continue
            forms.append("spm" if draws[3][i] % 100 < spm_rate else "psm")
            outputs.append(rearranged(text, int(first[i - start]), int(second[i - start]), forms[-1]))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    return pa.RecordBatch.from_arrays(
        [pa.array(forms, pa.string()), pa.array(n), pa.array(first_cut, mask=plain), pa.array(second_cut - first_cut, mask=plain),
         pa.array(outputs, pa.binary()).cast(pa.string())],
        names=["form", "n", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(text: Column, doc_id: Column, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> Column:
    """Struct of form, n (code points), prefix_chars, middle_chars and output for each text.

    The four draws are the first 8-digit groups of the sha256 of the seed and
    the id.  ``prefix_chars`` and ``middle_chars`` are null for plain texts.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.arrow_udf(RESULT)
    def transform(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        numbers = [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)]
        return transform_batch(texts, numbers, rate, spm_rate).to_struct_array()

    return transform(text_or_empty(text), *draws)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; by its marks alone."""

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(opening) + 1))
        cut = F.instr(body, between)
        rest = F.substr(body, cut + len(between))
        end = F.instr(rest, MIDDLE)
        return F.substr(body, F.lit(1), cut - 1), F.substr(rest, F.lit(1), end - 1), F.substr(rest, end + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    last, first, between = parts(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(first, between, last)).otherwise(output))


def with_infill(docs: DataFrame, column: str = "infill") -> DataFrame:
    """``docs`` (doc_id, text, any others) and a struct column as ``fill_in_middle`` gives it.

    The column's name is lengthened where ``docs`` has it already.
    """
    return docs.withColumn(fresh(column, docs.columns), fill_in_middle(F.col("text"), F.col("doc_id")))
