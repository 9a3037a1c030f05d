"""Near duplicates against all pairs on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credo.llm import minhash
from credo.llm.components import components
from credo.llm.queries import op4_near_duplicates
from tests.llm.cases import documents, set_of, with_extra, write_documents


def groups(rows):
    """component of each (doc_id, text) by comparing all pairs."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, s) for i, t in rows if (s := set_of(t))]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    want = groups(rows)
    assert len(found) == len(want)
    for i, text in rows:
        r = found[i]
        assert (r["component_id"], r["kept"], r["n_shingles"]) == (want[i], want[i] == i, len(set_of(text)))


def test_chains_of_edits_and_shared_passages(spark):
    """Groups whose ends are far apart, and a passage that unlike documents share."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 14)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice((0, 1, 2, 3))):
                text[rng.randrange(len(text))] = word()
    for _ in range(60):
        text = [word() for _ in range(rng.randrange(5, 60))]
        at = rng.randrange(len(text))
        rows.append(" ".join(text[:at] + passage + text[at:]))
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_large_group_of_near_copies_around_one_text(spark):
    """Copies that are close to the middle, not to each other."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(150):
        text = list(base)
        for _ in range(3 if n != 77 else 0):
            text[rng.randrange(120)] = f"n{rng.randrange(10**9)}"
        rows.append((n, " ".join(text)))
    check(spark, rows)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = op4_near_duplicates(spark, write_documents(spark, tmp_path)).collect()
    docs = documents(spark).collect()
    assert len(rows) == len(docs)
    named = [(r["doc_id"], r["text"]) for r in docs if r["doc_id"] is not None]
    want = groups(list(dict.fromkeys(named)))
    by_id = {}
    for r in rows:
        if r["doc_id"] is None:  # equal words as document 6, or no text
            assert (r["component_id"], r["kept"]) == ((6, False) if r["n_shingles"] else (None, True))
        else:
            by_id.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    for i, found in by_id.items():
        assert found == {(want[i], want[i] == i)}, i


def test_rows_without_id(spark):
    """One row of each text, and none where a document has the text."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a), (None, a), (None, a.upper()), (None, b), (None, b), (None, b + "  "), (None, ""), (None, None), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in minhash.near_duplicates(docs).collect()]
    want = [(5, 5, True, 4), (None, 5, False, 4), (None, 5, False, 4), (None, None, True, 4), (None, None, False, 4),
            (None, None, False, 4), (None, None, True, 0), (None, None, True, 0), (7, 7, True, 1)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    kept = [tuple(r) for r in minhash.one_of_each(docs).collect()]
    assert sorted((i, (t or "").strip()) for i, t in kept if i is not None) == [(5, a), (7, "x")]
    assert sorted((t or "").strip() for i, t in kept if i is None) == ["", "", b]


def test_comparisons_grow_with_the_group(spark, monkeypatch):
    """Three times the near copies of one text: the pairs that meet in lists grow about as much, not with the square."""
    met = {}

    def corpus(n):
        rng, base = random.Random(8), [f"b{i}" for i in range(120)]
        for k in range(n):
            text = list(base)
            for _ in range(3 if k else 0):
                text[rng.randrange(120)] = f"n{rng.randrange(10**9)}"
            yield k, " ".join(text)

    plain = minhash.can_be_similar
    for n in (150, 450):
        seen = spark.sparkContext.accumulator(0)
        count = F.udf(lambda seen=seen: seen.add(1) or True, "boolean").asNondeterministic()
        monkeypatch.setattr(minhash, "can_be_similar", lambda *a: count() & plain(*a))
        rows = list(corpus(n))
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == groups(rows)
        met[n] = seen.value
    assert met[450] <= 5 * met[150], met


def test_unlike_texts_with_one_passage_meet_once(spark, monkeypatch):
    """A long passage makes many lists of the same members; their pairs are compared in the first, as a rule."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(n, " ".join([f"a{n}x{i}" for i in range(20)] + passage + [f"b{n}x{i}" for i in range(20)])) for n in range(10)]
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda seen=seen: seen.add(1) or True, "boolean").asNondeterministic()
    monkeypatch.setattr(minhash, "can_be_similar", lambda *a: count())
    check(spark, rows)
    assert 45 <= seen.value <= 200, seen.value


def test_parity_parts_long_unlike_sets(spark):
    """Sets of thousands of shingles: those below 3/4 are told apart, those at 3/4 pass."""
    rng = np.random.default_rng(5)

    def pair(common, own):
        x = rng.integers(-2**63, 2**63 - 1, common + 2 * own)
        both = (np.sort(np.concatenate((x[:common], y))) for y in (x[common:common + own], x[common + own:]))
        return [v for found in both for v in (len(found), minhash.parity(found, minhash.LONG_BITS).tolist())]

    def passing(common, own):
        df = spark.createDataFrame([pair(common, own) for _ in range(40)], "n long, x array<long>, m long, y array<long>")
        return df.filter(minhash.can_be_similar(F.col("n"), F.col("x"), F.col("m"), F.col("y"), minhash.LONG_BITS)).count()

    for n in (100, 1000, 3000, 12000):
        assert passing(6 * (n // 7), n // 7) == 40  # similarity 3/4
    for n in (100, 1000, 3000):
        assert passing(n // 10 * 7, n // 10 * 3) == 0  # 7/13


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = with_extra(documents(spark))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r["doc_id"] for r in minhash.near_duplicates(documents(spark)).filter("kept").collect()} - {None}


def test_empty(spark, tmp_path):
    assert op4_near_duplicates(spark, write_documents(spark, tmp_path, empty=True)).count() == 0
    assert minhash.one_of_each(documents(spark, empty=True)).count() == 0


def test_retained_values_are_the_smallest():
    words = [f"w{i}".encode() for i in range(300)]
    x = minhash.shingles(words)
    assert len(x) == 296 and (np.diff(x) > 0).all()
    assert (minhash.shingles(words[:4]) != minhash.shingles(words[:3])).all()


@pytest.mark.parametrize("links", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (9, 8)], [(1, n) for n in range(2, 40)] + [(39, 100), (200, 100)]])
def test_components(spark, links):
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {x: x for pair in links for x in pair}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {x: p for x, p in parent.items() if any(a != b and x in (a, b) for a, b in links)}


def test_plan_has_no_cross_join(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text")
    plan = minhash.near_duplicates(docs)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None
