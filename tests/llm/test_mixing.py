"""Source mixing against exact water-filling and a plain version of the draw."""

import hashlib
import re
from fractions import Fraction

from credo.llm import mixing
from credo.llm.queries import op10_mix
from tests.llm.cases import documents, with_extra, write_documents

size = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))


def exact_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def plain(rows, seed=mixing.SEED):
    """(id, size, source size, target, taken) of each (id, text, source)."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, out = exact_targets(sizes), []
    for source, target in targets.items():
        own = [(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, size(t)) for i, t, s in rows if s == source]
        ratio = target / sizes[source] if sizes[source] else Fraction(0)
        whole = ratio.numerator // ratio.denominator
        want = target - whole * sizes[source]
        for draw, i, n in own:
            before = sum(m for d, _, m in own if d < draw)
            peers = sum(m for d, _, m in own if d == draw)
            extra = want > 0 and before + Fraction(peers, 2) <= want
            out.append((i, n, sizes[source], round(float(target), 6), n * (whole + extra)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((*r[:3], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark).collect()]
    path = write_documents(spark, tmp_path)
    first = rows_of(op10_mix(spark, path))
    assert first == plain(rows) == rows_of(op10_mix(spark, path))


def test_small_sources_are_clamped_and_the_rest_shared(spark, tmp_path):
    rows = [(n, "word " * (1 + n % 40), f"s{n % 3}" if n > 12 else f"t{n % 5}") for n in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op10_mix(spark, str(tmp_path)))
    assert got == plain(rows)
    assert sum(r[4] for r in got) - sum(r[1] for r in got) in range(-200, 200)
    assert all(r[4] <= 3 * r[1] for r in got)


def test_only_empty_texts(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (3, " ", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op10_mix(spark, str(tmp_path))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = with_extra(documents(spark))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark).collect()]
    taken = sum(r["n"] or 0 for r in mixed.select(mixing.word_count("text").alias("n")).collect())
    assert taken == sum(r[4] for r in plain(rows))


def test_empty(spark, tmp_path):
    assert op10_mix(spark, write_documents(spark, tmp_path, empty=True)).count() == 0
    assert mixing.mix(documents(spark, empty=True)).count() == 0
