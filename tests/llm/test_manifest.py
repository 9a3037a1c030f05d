"""The manifest against trees built as plain lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from credo.llm import manifest
from credo.llm.queries import op13_manifest
from tests.llm.cases import documents, write_documents

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


CLAIMED = "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 2 = 0 THEN replace(text, '\n', '') ELSE text END"


def leaf(r, text):
    return H(*(enc(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i:i + 3]) for i in range(0, len(now), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 3 * 3
        out.append((i - low, [d for j, d in enumerate(level[low:low + 3], low) if j != i]))
        i //= 3
    return out


def plain(rows):
    """The rows of op13, one for each of ``rows``."""
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
    built = {s: tree([x[2] for x in trees[s]]) for s in order}
    top = tree([built[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(trees[s]):
            proof = siblings(built[s], i) + siblings(top, k)
            odd = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2
            text = r["text"] if odd or r["text"] is None else r["text"].replace("\n", "")
            now = leaf(r, text)
            for place, others in proof:
                now = H(*others[:place], now, *others[place:])
            root = top[-1][0]
            out.append((r["doc_id"], own, built[s][-1][0], root, H(*(d for _, o in proof for d in o)), now, now == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = documents(spark).collect()
    assert rows_of(op13_manifest(spark, write_documents(spark, tmp_path))) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert op13_manifest(spark, write_documents(spark, tmp_path, empty=True)).count() == 0


@pytest.mark.parametrize("part_rows, step", [(4, 1), (7, 2), (20_000, 7)])
def test_sizes_of_sources(spark, part_rows, step):
    """Small blocks and partitions: every kind of run, several steps, sources of one row and a hot one."""
    r = random.Random(3)
    rows = [(r.randrange(10**6), f"line {i}\nmore {i}", "en", None if i % 41 == 0 else f"s{min(i % 17, 9) if i % 3 else 'hot'}", i) for i in range(400)]
    rows += [(5, None, None, "alone", None), (6, "b", "en", "é", 1), (6, "b", "en", "é", 1), (7, "", "en", "z\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = manifest.with_proofs(docs.repartition(5), F.expr(CLAIMED), part_rows, step)
    found = found.withColumn("proof_sha256", F.sha2(F.array_join("proof", "").cast("binary"), 256))
    found = rows_of(found.withColumn("verified", F.col("folded_root") == F.col("root")))
    assert found == plain(docs.collect())
    assert {x[-1] for x in found} == {True, False}


def test_missing_is_minimal():
    """Each missing coordinate is needed by some proof, none can be derived, and none is asked twice."""
    for n in (1, 2, 3, 4, 9, 10, 27, 40):
        levels = tree([H(str(i)) for i in range(n)])
        for first in range(n):
            for last in range(first, n):
                wanted = manifest.missing(first, last, n)
                needed = set()
                for i in range(first, last + 1):
                    at = i
                    for level, nodes in enumerate(levels[:-1]):
                        low = at // 3 * 3
                        for j in range(low, min(low + 3, len(nodes))):
                            covers = range(j * 3**level, min((j + 1) * 3**level, n))
                            if j != at and not any(first <= x <= last for x in covers):
                                needed.add((level, j))
                        at //= 3
                assert len(wanted) == len(set(wanted))
                assert set(wanted) == needed
                fetched = {(a, b): levels[a][b] for a, b in wanted}
                above = manifest.interiors(first, n, levels[0][first:last + 1], fetched)
                for i in range(first, last + 1):
                    proof = manifest.path(i, n, above)
                    assert proof == siblings(levels, i)
                    assert manifest.fold(levels[0][i], proof) == levels[-1][0] == above[-1][0]


def test_other_columns_and_missing_fields(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    extra = rows.select("*", F.lit(1).alias("part"), F.lit("x").alias("tree"), F.lit(3).alias("idx"), F.lit("y").alias("digest"))
    a, b = (sorted((tuple(r) for r in manifest.with_proofs(d, F.col("text")).collect()), key=repr) for d in (rows, extra))
    assert a == b and all(r[4] == r[7] for r in a)
    nulls = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "n_chars")))
    assert sorted((tuple(r) for r in manifest.with_proofs(nulls, F.col("text")).collect()), key=repr) == a
