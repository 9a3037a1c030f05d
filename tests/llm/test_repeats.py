"""Removal of repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credo.llm import repeats
from credo.llm.common import slices
from credo.llm.queries import op11_repeats
from tests.llm.cases import documents, with_extra, write_documents


def brute(texts, length):
    """(kept bytes, spans) of each text."""
    count = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes(), spans))
    return out


def found(df):
    return [(bytes(r["unique"]["kept"]), [(s["start"], s["stop"]) for s in r["unique"]["spans"]]) for r in df.collect()]


def check(spark, texts, length, first, steps):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    done = found(repeats.without_repeats(docs, "unique", length, first, steps).orderBy("doc_id"))
    assert done == brute([(t or "").encode() for t in texts], length)


def corpus(seed, size):
    """Copies, near copies, shared passages, runs of one letter and periods, in bytes of several widths."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé汉😀 ") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(60).split(" ")
    out = [None, "", "a", "a" * 500, "b" * 39 + "a" * 300, "ab" * 300, "abc" * 90 + text(20) + "abc" * 90]
    for i in range(size):
        kind = i % 5
        if kind == 0:
            out.append(text(r.randrange(0, 80)))
        elif kind == 1:
            out.append(text(r.randrange(0, 9)) + passage + text(r.randrange(0, 9)))
        elif kind == 2:
            copy = list(base)
            for _ in range(3):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        elif kind == 3:
            cut = r.randrange(len(passage))
            out.append(passage[cut:] + text(5) + passage[:cut])
        else:
            out.append(r.choice(out) or "")
    return out


@pytest.mark.parametrize("length, first, steps", [(40, 8, (8, 2, 1)), (41, 41, (1,)), (16, 1, (16, 4, 1)), (64, 10, (32, 8, 1))])
def test_against_all_windows(spark, length, first, steps):
    check(spark, corpus(length, 60), length, first, steps)


def test_production_length(spark):
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    a, b, c = line(399), line(400), line(1500)
    texts = [a + "1", "2" + a, "3" + b, "4" + b, c, c[:700] + "x" + c[701:], c[300:1300], line(3000), "z" * 2000, c + line(10) + c, c]
    check(spark, texts, repeats.LENGTH, repeats.FIRST, repeats.STEPS)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents(spark).collect()]
    expected = []
    for (i, t), (kept, spans) in zip(rows, brute([t for _, t in rows], 400)):
        expected.append((i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    done = sorted((tuple(r) for r in op11_repeats(spark, write_documents(spark, tmp_path)).collect()), key=repr)
    assert done == sorted(expected, key=repr)


def test_empty_table(spark, tmp_path):
    assert op11_repeats(spark, write_documents(spark, tmp_path, empty=True)).count() == 0


def test_other_columns_null_and_repeated_ids(spark, monkeypatch):
    """The path for more texts than are broadcast gives the same rows."""
    text = "".join(random.Random(1).choice("abcdef") for _ in range(900))
    rows = [(None, text), (None, text), (3, text[:600]), (3, text[:600]), (3, "short"), (4, None), (5, text[200:] + "x" * 500)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("text_key", F.lit(1)).withColumn("Unique", F.lit("u"))
    done = repeats.without_repeats(docs, "unique")
    assert done.columns == [*docs.columns, "unique_"]
    plain = lambda df: sorted((r["doc_id"], r["text"], r["Unique"], bytes(r["unique_"]["kept"])) for r in df.fillna(-1, ["doc_id"]).fillna("", ["text"]).collect())
    first = plain(done)
    kept = [k for k, _ in brute([(t or "").encode() for _, t in rows], 400)]
    assert [x[3] for x in first] == [k for _, k in sorted(zip([(-1 if i is None else i, t or "") for i, t in rows], kept))]
    monkeypatch.setattr(repeats, "STRETCHES_BROADCAST", 0)
    assert plain(repeats.without_repeats(docs, "unique")) == first


def test_segments_of_long_texts(spark, monkeypatch):
    """A text is cut in segments; strings that cross a cut are still found."""
    r = random.Random(9)
    text = "".join(r.choice("abcdefghij ") for _ in range(40_000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = repeats.anchored(data, np.array([0]), np.array([len(data)]), 400, 64)
    starts = np.arange(0, len(data) - 399, 7_000)
    parts = [repeats.anchored(data[s:min(s + 7_399, len(data))], np.array([0]), np.array([min(7_399, len(data) - s)]), 400, 64) for s in starts]
    windows = lambda x: np.repeat(x[1], x[2]) + np.arange(x[2].sum()) - np.repeat(np.cumsum(x[2]) - x[2], x[2])
    assert windows(whole).tolist() == [w + s for s, x in zip(starts, parts) for w in windows(x).tolist()] == list(range(len(data) - 399))
    key = lambda x: np.repeat(x[4], x[2]).tolist()
    assert key(whole) == [k for x in parts for k in key(x)]
    long = "".join(r.choice("abcdefghij ") for _ in range(repeats.SEGMENT + 3_000))
    place = repeats.SEGMENT - 200
    check_at = [(1, long), (2, "start" + long[place:place + 450] + "end")]
    done = repeats.without_repeats(spark.createDataFrame(check_at, "doc_id long, text string"), "unique").orderBy("doc_id").collect()
    assert [tuple(s) for s in done[0]["unique"]["spans"]] == [(place, place + 450)]
    assert [tuple(s) for s in done[1]["unique"]["spans"]] == [(5, 455)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 30))
def test_names_are_of_contents(values, length):
    data = np.array(values, np.uint8)
    name = repeats.names(data, (1, length))[length]
    assert len(name) == max(0, len(values) - length + 1)
    for i in range(len(name)):
        for j in range(i):
            assert (name[i] == name[j]) == (values[i:i + length] == values[j:j + length])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 50), st.integers(0, 50), st.integers(1, 60), st.integers(1, 20))
def test_cut_covers_each_window_once(off, start, count, step):
    if start + count - 1 > off:
        return
    row, first, last, number = repeats.cut(np.array([off]), np.array([start]), np.array([count]), step)
    assert sorted(p for a, b in zip(first, last) for p in range(a, b + 1)) == list(range(start, start + count))
    assert all((off - p) // step == n for a, b, n in zip(first, last, number) for p in range(a, b + 1))


class Rows:
    """Stands for a DataFrame; gives what mapInArrow would run in a task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_is_named_in_slices(monkeypatch):
    """Names take eight times the bytes, so a batch's stretches aren't all named at once."""
    r = random.Random(3)
    data = [bytes(r.choices(b"abcd", k=r.randrange(463, 900))) for _ in range(3000)]
    parts = [[{"start": 0, "windows": min(64, len(d) - 399), "copies": 1}] for d in data]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("copies", pa.int32())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d[:16] for d in data]), pa.array(range(len(data)), pa.int64()), pa.array([63] * len(data), pa.int32()), pa.array(data), pa.array(parts, kind)],
        names=["text_key", "at", "off", "data", "parts"])
    named, plain = [], repeats.names
    monkeypatch.setattr(repeats, "names", lambda x, lengths: named.append(len(x)) or plain(x, lengths))
    run = repeats.finer_stretches(Rows(), 8, 400)
    done = pa.Table.from_batches(run(iter([batch.slice(0, 0), batch])))
    assert sum(named) == sum(map(len, data)) and max(named) <= 1 << 18
    alone = pa.Table.from_batches([x for i in range(0, 3000, 250) for x in run(iter([batch.slice(i, 1)]))])
    places = [x % 250 == 0 for x in done["at"].to_pylist()]
    assert done.filter(pa.array(places)).to_pylist() == alone.to_pylist()


def test_kept_bytes_leave_in_slices(spark):
    """Values that are longer than a slice, null windows and many small ones keep their rows."""
    texts = ["x" * n for n in (0, 5, 400_000, 7, 300_000, 300_000, 9)] + [f"text {i}" for i in range(50)]
    assert list(slices(pa.array(texts, pa.string()).slice(1), 1 << 18)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 56)]
    assert list(slices(pa.array([None, b"ab", None], pa.binary()), 1)) == [(0, 1), (1, 2), (2, 3)] and not list(slices(pa.array([], pa.string()), 1))
    docs = spark.createDataFrame([(i, t, [(0, 3), (6, 1)] if len(t) > 6 else None) for i, t in enumerate(texts)], "i long, t string, w array<struct<at:bigint,windows:bigint>>")
    out = docs.coalesce(1).select("i", repeats.without(F.col("t"), F.col("w"), 2).alias("unique")).orderBy("i").collect()
    expected = [t[4:6] + t[8:] if len(t) > 6 else t for t in texts]
    assert [bytes(r["unique"]["kept"]).decode() for r in out] == expected
