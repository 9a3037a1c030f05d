"""Fill-in-the-middle against plain slicing of code points."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credo.llm import infill
from credo.llm.queries import op12_fill_in_middle
from tests.llm.cases import documents, with_extra, write_documents

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text, rate=90, spm_rate=20):
    """(n, form, prefix_chars, middle_chars, output) by Python's own strings."""
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(text), "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    expected = []
    for r in documents(spark).collect():
        n, form, first, middle, output = plain(r["doc_id"], r["text"])
        expected.append((r["doc_id"], n, form, first, middle, sha(output), sha(r["text"] or "")))
    assert rows_of(op12_fill_in_middle(spark, write_documents(spark, tmp_path))) == sorted(expected, key=repr)


def test_empty_table(spark, tmp_path):
    assert op12_fill_in_middle(spark, write_documents(spark, tmp_path, empty=True)).count() == 0


def test_marks_and_near_marks(spark):
    texts = ["<P>", "a<S>b", "x<M>", "<", "<P", "<S", "<<S", "P>S>M>", "><", "<S<S<M<M<P", "汉<S汉字<", "<P <S <M", "😀<M😀"]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(10)]
    docs = infill.with_infill(spark.createDataFrame(rows, "doc_id long, text string"))
    found = docs.select("doc_id", "text", "infill.*", infill.restore(F.col("infill.output"), F.col("infill.form")).alias("again")).collect()
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["again"] == r["text"]
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_other_columns_stay(spark):
    docs = with_extra(documents(spark)).withColumn("infill", F.lit(7)).withColumn("OUTPUT", F.lit("o"))
    done = infill.with_infill(docs)
    assert done.columns == [*docs.columns, "infill_"]
    assert rows_of(done.select("infill", "OUTPUT").distinct()) == [(7, "o")]


@given(st.text(alphabet=st.sampled_from("ab é汉😀\n"), max_size=60))
def test_index_converts_both_ways(text):
    index = infill.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    expected = [len(text[:i].encode()) for i in chars]
    assert index.bytes(chars).tolist() == expected
    assert index.chars(np.array(expected)).tolist() == chars.tolist()


def test_ascii_needs_no_entry():
    assert len(infill.ExceptionIndex(np.frombuffer(b"plain text" * 100, np.uint8)).at_byte) == 0


@pytest.mark.parametrize("size", [1, 7, 1 << 23])
def test_slices_don_t_change_the_result(monkeypatch, size):
    monkeypatch.setattr(infill, "SLICE_BYTES", size)
    texts = ["", "a" * 30, "é" * 9, "", "汉字" * 11, "x", "😀"] * 3
    draws = [np.arange(len(texts), dtype=np.int64) * k for k in (7, 11, 13, 17)]
    # a sliced array starts inside its buffers
    batch = infill.transform_batch(pa.array(["skipped", *texts])[1:], draws, 90, 20).to_pylist()
    for i, (text, row) in enumerate(zip(texts, batch)):
        a, b = sorted((draws[0][i] % (len(text) + 1), draws[1][i] % (len(text) + 1)))
        assert row["n"] == len(text)
        if row["form"] != "plain":
            assert (row["prefix_chars"], row["middle_chars"]) == (a, b - a)
            assert row["output"] == infill.rearranged(text.encode(), len(text[:a].encode()), len(text[:b].encode()), row["form"]).decode()
