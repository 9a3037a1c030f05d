"""Removal of byte strings that occur twice, by ranks of growing length.

A byte is removed if some ``LENGTH``-byte string that covers it also starts
anywhere else, in the same text or another; strings never cross texts.  The
question for each window (the ``LENGTH`` bytes from a position) is whether it
is unique.

This is prefix doubling: a string's name is made of the names of two shorter
ones at an offset, and equal strings have equal names.  Inside a text, names
double from 1 byte on, in arrays.  Across texts, Spark sorts and counts (name,
name at an offset) pairs, of strings that grow each round; what is unique drops
out, and the rest is ranked again by longer strings until it is unique or the
length is reached.  Plain doubling has a row for each byte of the corpus
in each round.  Here rows stand for stretches of windows instead:

* Round 0.  In each window, the ``FIRST``-byte string with the smallest name
  is the window's anchor.  Equal windows have their anchors in the same place,
  so windows fall into stretches with a common anchor, about one for 170
  bytes.  A stretch whose anchor string is unique drops out.
* A stretch is named by its whole content too (the pair of its first and
  last window).  Stretches with equal content are repeated altogether; of each
  content one stretch stays to meet stretches that are equal only in part.
* Round by round, what is left (same anchor, other content) is cut into
  stretches of ``STEPS`` windows, in step with the anchor.  A stretch of g
  windows has ``LENGTH - g + 1`` bytes in all of its windows, so the ranked
  strings grow (64, 337, 393, 400 bytes) and the last round ranks single
  windows.

Names are 64-bit hashes; two stretches are taken for equal if both of their
names are, 128 bits in all.  Every row is a stretch of one text; texts and
groups are never gathered.  Copies of a text, or a passage that stands in
a third of all texts, meet as counted names (partial sums in each task), and
names return to the rows by ``split_join``, which broadcasts the few hot ones.

Null texts count as empty; texts shorter than ``LENGTH`` lose nothing.  Rows may
repeat, ids too, or be null: the text alone decides, and equal texts get equal
results (each byte of a repeated text of at least ``LENGTH`` bytes is removed).
An empty table gives an empty result.  Long texts are read in segments of
``SEGMENT`` windows; a stretch cut there is an unlike stretch, no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import fresh, give_back, slices, stored, text_or_empty
from credo.operators.skew import split_join

LENGTH, FIRST = 400, 64
#: Windows of a stretch in the rounds after the first; the last must be 1.
STEPS = (64, 8, 1)
SEGMENT = 1 << 19
#: Bytes ranked at once; an anchor's place has to fit below its name's upper bits.
SLICE = 1 << 20
#: Bytes of an Arrow batch that are worked on at once, if it has several texts; names take eight times as many.
BYTES_AT_ONCE = 1 << 18
#: Up to so many stretches are broadcast (some 120 bytes each) to their texts; more meet them in a shuffle.
STRETCHES_BROADCAST = 500_000

RESULT = "struct<kept:binary,spans:array<struct<start:bigint,stop:bigint>>>"
_HASH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _HASH[3]
    return x ^ (x >> np.uint64(32))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two names in this order."""
    return left * _HASH[1] + mixed(right)


def names(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, the names of the strings of so many bytes from each position.

    Names of n bytes are doubled to 2 n; a length between is the pair of two
    overlapping strings.
    """
    now, n, out = (data.astype(np.uint64) + np.uint64(1)) * _HASH[0], 1, {}
    for length in sorted(lengths):
        while n * 2 <= length:
            now, n = paired(now[:-n], now[n:]) if n < len(now) else now[:0], n * 2
        more = length - n
        out[length] = mixed(now if not more else paired(now[:-more], now[more:]) if more < len(now) else now[:0])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, from block-wise running minima."""
    count = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:count], up[width - 1:width - 1 + count])


def content(windows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The name of the windows ``first`` to ``last`` (less than a window apart)."""
    return mixed(paired(windows[first], windows[last] + (last - first).astype(np.uint64)))


def anchored(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """Stretches of the texts ``data[start:stop]``, in order, each at least ``length`` long.

    text, position of the first window, windows, distance of the anchor, name
    of the anchor, name of the content.
    """
    name = names(data, (first, length))
    place = np.uint64(SLICE - 1)
    best = sliding_min((name[first] & ~place) | np.arange(len(name[first]), dtype=np.uint64), length - first + 1) & place
    ends = stops - length + 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    new = np.concatenate(([True], best[1:] != best[:-1]))
    new[starts] = True
    begin = np.flatnonzero(new & (np.cumsum(inside[:len(best)]) > 0))
    text = np.searchsorted(starts, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), ends[text])
    anchor = best[begin].astype(np.int64)
    return text, begin, end - begin, anchor - begin, name[first][anchor], content(name[length], begin, end - 1)


def cut(off: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """The stretches (``start``, ``count`` windows, of a text whose anchor is ``off`` on) cut in step with the anchor.

    Row, first window, last window and number of each piece; the number counts from the anchor.
    """
    top, low = (off - start) // step, (off - start - count + 1) // step
    pieces = top - low + 1
    row = np.repeat(np.arange(len(off)), pieces)
    number = top[row] - (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.maximum(start[row], off[row] - number * step - step + 1)
    last = np.minimum((start + count - 1)[row], off[row] - number * step)
    return row, first, last, number


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each value starts in them (and the last stops)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


STRETCH = "text_key binary, at long, start int, windows int, off int, key long, content long, copies int"


def _stretches(text_key: pa.Array, at, start, windows, off, key, content, copies) -> pa.RecordBatch:
    columns = [text_key, pa.array(at, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, windows, off)),
               pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(copies.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["text_key", "at", "start", "windows", "off", "key", "content", "copies"])


def first_stretches(texts: DataFrame, length: int, first: int) -> DataFrame:
    """The stretches (``STRETCH``) of each row of ``texts`` (text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            # (row, from, to) in the buffer; the windows of a segment don't overlap those of the next
            parts = [(i, s, min(s + SEGMENT + length - 1, offsets[i + 1]))
                     for i in range(len(batch)) for s in range(offsets[i], offsets[i + 1] - length + 1, SEGMENT)]
            done = 0
            while done < len(parts):
                base, stop = parts[done][1], done + 1
                while stop < len(parts) and parts[stop][2] - base <= BYTES_AT_ONCE and parts[stop][0] != parts[stop - 1][0]:
                    stop += 1
                row, low, high = (np.array(x, np.int64) for x in zip(*parts[done:stop]))
                text, begin, n, off, key, whole = anchored(data[base:high[-1]], low - base, high - base, length, first)
                row = row[text]
                yield _stretches(batch.column(0).take(pa.array(row)), begin + base - offsets[row], np.zeros_like(n), n, off, key, whole, np.ones_like(n))
                done = stop
        give_back()

    return texts.mapInArrow(run, STRETCH)


def finer_stretches(rows: DataFrame, step: int, length: int) -> DataFrame:
    """The stretches of up to ``step`` windows of ``rows`` (text_key, at, off, data, parts).

    ``parts`` (start, windows, copies) are counted from ``at``, where ``data`` starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(whole.column("data"), BYTES_AT_ONCE):
                batch = whole.slice(low, high - low)
                data, offsets = _bytes(batch.column("data"))
                base = offsets[0]
                core = length - step + 1
                name = names(data[base:offsets[-1]], (core, length))
                parts = batch.column("parts")
                row = np.repeat(np.arange(len(batch)), parts.value_lengths().to_numpy(zero_copy_only=False))
                start, windows, copies = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in parts.flatten().flatten())
                off = batch.column("off").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                piece, begin, last, number = cut(off, start, windows, step)
                row, off, copies = row[piece], off[piece], copies[piece]
                here = offsets[row] - base
                key = mixed(paired(name[core][here + off - number * step], number.astype(np.uint64)))
                at = batch.column("at").to_numpy(zero_copy_only=False)[row]
                yield _stretches(batch.column("text_key").take(pa.array(row)), at, begin, last - begin + 1, off, key,
                                 content(name[length], here + begin, here + last), copies)
        give_back()

    return rows.select("text_key", "at", "off", "data", "parts").mapInArrow(run, STRETCH)


def judged(rows: DataFrame) -> DataFrame:
    """Stored stretches that aren't alone: total (how often their content occurs) and open (others share the key only)."""
    contents = rows.groupBy("key", "content").agg(F.sum("copies").alias("total"))
    keys = contents.groupBy("key").agg(F.count("*").alias("kinds"), F.min("total").alias("least"))
    keys = keys.filter("kinds > 1 and least = 1").select("key", F.lit(True).alias("open"))
    contents = stored(contents, "contents")
    found = split_join(contents, stored(keys, "open-keys"), ["key"])
    found = found.select("key", "content", "total", F.coalesce("open", F.lit(False)).alias("open")).filter("total > 1 or open")
    return stored(split_join(rows, stored(found, "found"), ["key", "content"], "inner"), "judged")


def one_of_each(rows: DataFrame) -> DataFrame:
    """text_key, at, off and parts to look at closer: one stretch of each content that is open."""
    place = F.struct("text_key", "at", "off", "start", "windows")
    chosen = rows.filter("open").groupBy("key", "content").agg(F.min(place).alias("place"), F.max("total").alias("total"))
    part = F.struct("place.start", "place.windows", F.least("total", F.lit(2)).cast("int").alias("copies"))
    return chosen.groupBy("place.text_key", "place.at", "place.off").agg(F.collect_list(part).alias("parts"))


def with_data(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` stretches of round 0 (one part each, from 0) with their bytes; ``docs`` are text_key, doc_id, text."""
    own = wanted.groupBy("text_key").agg(F.collect_list(F.struct("at", "off", "parts")).alias("stretches"))
    # any row with the text will do
    own = own.join(docs.groupBy("text_key").agg(F.min("doc_id").alias("id")), "text_key")
    own = stored(own.withColumnRenamed("text_key", "of"), "wanted")
    if wanted.count() <= STRETCHES_BROADCAST:
        own = F.broadcast(own)
    rows = docs.join(own, (F.col("text_key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    rows = rows.select("text_key", F.col("text").cast("binary").alias("text"), F.explode("stretches").alias("s"))
    size = F.element_at("s.parts", 1)["windows"] + (length - 1)
    rows = rows.select("text_key", "s.at", "s.off", "s.parts", F.substr("text", (F.col("s.at") + 1).cast("int"), size.cast("int")).alias("data"))
    # rows that repeat bring a stretch more than once
    return rows.groupBy("text_key", "at").agg(*(F.first(c).alias(c) for c in ("off", "parts", "data")))


def repeated_windows(docs: DataFrame, length: int = LENGTH, first: int = FIRST, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """text_key, at and windows of stretches of repeated windows in ``docs`` (text_key, doc_id, text)."""
    texts = docs.filter(F.octet_length("text") >= length)
    rows = stored(first_stretches(texts.select("text_key", "text"), length, first), "stretches")
    out, data = [], None
    for step in (*steps, 0):
        rows = judged(rows)
        mine = rows.filter("total > 1 and copies = 1")
        out.append(mine.select("text_key", (F.col("at") + F.col("start")).alias("at"), "windows").distinct())
        if not step:
            break
        wanted = stored(one_of_each(rows), "open")
        if data is None:
            data = stored(with_data(docs, wanted, length), "data")
            rows = data
        else:
            rows = data.drop("parts", "off").join(wanted, ["text_key", "at"])
        rows = stored(finer_stretches(rows, step, length), "stretches")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def kept_parts(texts: pa.Array, found: pa.Array, length: int) -> pa.Array:
    """What ``RESULT`` says of each text whose repeated windows are the other array's value."""
    kept, spans = [], []
    for value, runs in zip(texts, found):
        data, own = value.as_py(), []
        for at, n in sorted((r["at"], r["windows"]) for r in runs.as_py() or ()):
            if own and at <= own[-1][1]:
                own[-1][1] = max(own[-1][1], at + n + length - 1)
            else:
                own.append([at, at + n + length - 1])
        edges = [0, *(x for span in own for x in span), len(data)]
        kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans.append([{"start": a, "stop": b} for a, b in own])
    kinds = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, pa.list_(kinds))], names=["kept", "spans"])


def without(text: Column, windows: Column, length: int) -> Column:
    """What ``RESULT`` says of a text whose repeated windows are ``windows`` (array of at, windows; null: none)."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            for low, high in slices(texts, BYTES_AT_ONCE):
                yield kept_parts(texts.slice(low, high - low), found.slice(low, high - low), length)
        give_back()

    return run(text.cast("binary"), windows)


def without_repeats(docs: DataFrame, column: str = "unique", length: int = LENGTH, first: int = FIRST,
                    steps: tuple[int, ...] = STEPS) -> DataFrame:
    """``docs`` (doc_id, text, any others) and a struct column (kept bytes, removed byte spans).

    ``kept`` may stop inside a character, as strings are of bytes.  The new
    column's name is lengthened where ``docs`` has it already.
    """
    key_name, of, runs = (fresh(f"_{n}", docs.columns) for n in ("text_key", "of", "runs"))
    text = text_or_empty(F.col("text"))
    slim = docs.select(text_key(text).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = repeated_windows(slim, length, first, steps)
    found = found.groupBy("text_key").agg(F.collect_list(F.struct("at", "windows")).alias(runs))
    found = stored(found, "repeats")
    keyed = docs.withColumn(key_name, text_key(text))
    bulk = found.agg(F.sum(F.size(runs))).first()[0] or 0
    if bulk <= STRETCHES_BROADCAST:
        rows = keyed.join(F.broadcast(found.withColumnRenamed("text_key", of)), F.col(key_name) == F.col(of), "left")
    else:
        # a text's runs meet its ids first, so that the texts themselves are dealt by id too
        ids = stored(slim.select("text_key", "doc_id").distinct(), "ids")
        found = split_join(ids, found, ["text_key"], "inner").select(F.col("text_key").alias(of), F.col("doc_id").alias(f"{of}_id"), runs)
        same = (F.col(key_name) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{of}_id"))
        rows = keyed.join(found, same, "left")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), without(text, F.col(runs), length).alias(fresh(column, docs.columns)))
