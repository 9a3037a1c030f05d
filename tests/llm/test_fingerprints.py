"""Merkle fingerprints against a plain version."""

import hashlib
import re

from pyspark.sql import functions as F

from credo.llm import merkle
from credo.llm.queries import op7_fingerprints
from tests.llm.cases import documents, write_documents

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def plain(text):
    """Fingerprint, and the distinct pieces' lengths."""
    sections, pieces = [], {}
    for part in text.split("\n\n"):
        lines = []
        for line in part.split("\n"):
            full = [md5(p) + f"{len(p):02x}" for p in re.findall(merkle.PIECES, line)]
            short = [f[:10] + f[32:] for f in full]
            pieces |= {s: int(s[10:], 16) for s in short}
            lines.append((md5(",".join(full)), short))
        sections.append((md5(",".join(h for h, _ in lines)), lines))
    root = hashlib.sha256(",".join(h for h, _ in sections).encode()).hexdigest()
    body = "/".join(h[:16] + "{" + "|".join(x[:16] + "=" + ",".join(s) for x, s in lines) + "}" for h, lines in sections)
    return f"{root}:{body}", pieces


def dice(a, b):
    both = sum(a.values()) + sum(b.values())
    return 2 * sum(v for k, v in a.items() if k in b) / both if both else 1.0


def want(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(order):
        x = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + x[:half]
        (f, p), (g, q), (_, y) = plain(t), plain(e), plain(x)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(dice(p, q), 12), round(dice(p, y), 12)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted(((*r[:5], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in df.collect()), key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert rounded(op7_fingerprints(spark, write_documents(spark, tmp_path))) == want(docs)


def test_neighbours_over_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    rows = [(i * i * 37 - 500, f"Text {i}. It has\nlines {i % 7}.\n\nAnd sections, {i % 3}!") for i in range(60)] + [(None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rounded(op7_fingerprints(spark, str(tmp_path))) == want(rows)


def test_roots_tell_texts_apart_and_edits_are_located(spark):
    texts = ["a\nb\n\nc", "a\nb\n\nc", "a\nB\n\nc", "a\n\nb\n\nc", "a\nb\n\nc\nd", "a\nb\n\nc\n", "a\nb\n\nc "]
    rows = [(n, a, b) for n, (a, b) in enumerate((x, y) for x in texts for y in texts)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = df.select("a", "b", *(merkle.fingerprint(merkle.tree(F.col(c))).alias(f"f{c}") for c in "ab"))
    df = df.select("a", "b", "fa", "fb", merkle.differing("fa", "fb").alias("where"))
    for r in df.collect():
        assert (r["fa"][:64] == r["fb"][:64]) == (r["a"] == r["b"]) == (not r["where"])
        x, y = [s.split("\n") for s in r["a"].split("\n\n")], [s.split("\n") for s in r["b"].split("\n\n")]
        at = lambda t, i, j: t[i][j] if i < len(t) and j < len(t[i]) else None
        changed = {(i, j) for i in range(5) for j in range(5) if at(x, i, j) != at(y, i, j)}
        assert {(w["section"], w["paragraph"]) for w in r["where"]} == changed


def test_no_python_in_the_plan(spark):
    plan = merkle.fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark, tmp_path):
    assert op7_fingerprints(spark, write_documents(spark, tmp_path, empty=True)).count() == 0
