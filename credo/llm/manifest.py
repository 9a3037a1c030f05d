"""Merkle manifest of a dataset, with an octopus multiproof for each leaf partition.

Every row is a leaf.  The leaves of a source, by ascending id, are the lowest
level of its tree; each ``ARITY`` consecutive nodes become one node of the next
level until one remains, the source's subroot.  The subroots, by source, are
the leaves of the top tree, whose last node is the root of the dataset.

Trees are built in blocks of ``ARITY ** STEP`` nodes: one group holds a block's
nodes and makes the levels above them, and the blocks' tops are the next
step's nodes.  A source with most of the rows is many blocks.

A row's place in its tree comes from a range sort: rows are written in sorted
partitions, the rows a partition has of each source are counted, and running
sums of those small counts give each partition's first place.  No window runs
over a source.

Proofs are made by leaf partitions (the rows that a sorted partition has of one
source, up to ``PART_ROWS``).  A partition's leaves are consecutive, so the
nodes that all their proofs need and that the partition can't derive are, on
each level, the other members of the first and the last run: this minimal
union of coordinates is computed from the partition's first and last place
alone and fetched by one join.  Inside the partition shared interior nodes are
derived once, from leaves and fetched nodes, and every leaf's own proof is read
off.  Folding a leaf with its proof gives the root again.

Digests are lower-case hex sha256 of concatenated inputs.  A null value is
``-``, any other its UTF-8 byte count, ``:`` and itself, so no two rows share an
encoding.  Null ids come first, null sources too; rows that share an id are
ordered by their digests (equal rows have equal digests, and each its own
place).  Columns outside ``FIELDS`` don't count; a field that is missing
counts as null.  An empty table has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credo.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels built by one group, which then holds 3 ** 7 nodes at most.
STEP = 7
#: Most rows of one source in a leaf partition.
PART_ROWS = 20_000
#: The tree of the subroots; sources are prefixed, so no source has this name.
TOP = "top"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value's part of a leaf: ``-`` or its byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row of ``docs``, with another text if given."""
    own = {c.lower(): c for c in docs.columns}
    values = [F.col(f"`{own[f]}`") if f in own else F.lit(None) for f in FIELDS]
    if text is not None:
        values[FIELDS.index("text")] = text
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def tree_name(source: Column) -> Column:
    """A source's tree; names order as sources do, null first."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("n"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with part (the sorted partition), idx (place in the tree, from 0) and n (its size).

    Ties of ``order`` may be placed either way.
    """
    # the number only deals ties, which are equal rows, over several partitions
    tie = "_tie"
    written = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange("tree", *order, tie)
    written = written.drop(tie).sortWithinPartitions("tree", *order)
    written = stored(written.withColumn("part", F.spark_partition_id().cast("long")), "sorted")
    runs = Window.partitionBy("part", "tree").orderBy(*order)
    written = written.withColumn("row", F.row_number().over(runs) - 1)
    counts = written.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    found = written.join(counts, ["tree", "part"])
    return found.withColumn("idx", F.col("start") + F.col("row")).drop("start", "row")


def levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    count = 0
    while n > 1:
        n, count = -(-n // ARITY), count + 1
    return count


def _block(table: pa.Table, step: int) -> pa.Table:
    """The nodes above one block, up to ``step`` levels or the tree's last node."""
    table = table.sort_by("idx")
    tree, level = table.column("tree")[0].as_py(), table.column("level")[0].as_py()
    n, first = table.column("n")[0].as_py(), table.column("idx")[0].as_py()
    nodes, out = table.column("digest").to_pylist(), []
    for up in range(1, step + 1):
        if n <= 1:
            break
        nodes = [digest(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]
        n, first = -(-n // ARITY), first // ARITY
        out += [(tree, level + up, first + i, d, n, up == step or n == 1) for i, d in enumerate(nodes)]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    columns = list(zip(*out)) or [()] * len(kinds)
    names = ["tree", "level", "idx", "digest", "n", "open"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def nodes_above(leaves: DataFrame, step: int = STEP) -> DataFrame:
    """All nodes (tree, level, idx, digest, n) of the trees over stored ``leaves`` (tree, idx, digest, n).

    Leaves are level 0; ``n`` is the number of nodes on the level.
    """
    now = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
    found = [now]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    for _ in range(-(-levels(largest) // step)):
        block = F.floor(F.col("idx") / ARITY ** step).alias("block")
        made = now.filter("n > 1").groupBy("tree", block).applyInArrow(
            lambda table: _block(table, step), "tree string, level int, idx long, digest string, n long, open boolean")
        made = stored(made, "nodes")
        found.append(made.drop("open"))
        now = made.filter("open").drop("open")
    return reduce(DataFrame.unionByName, found)


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that prove the leaves ``first`` to ``last`` of ``n`` and don't lie above them."""
    out, level = [], 0
    while n > 1:
        low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, n)
        out += [(level, i) for i in range(low, first)] + [(level, i) for i in range(last + 1, high)]
        first, last, n, level = first // ARITY, last // ARITY, -(-n // ARITY), level + 1
    return out


def interiors(first: int, n: int, leaves: list[str], fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Level by level, the nodes above consecutive ``leaves`` and beside them; the last level is the root's."""
    out, last = [], first + len(leaves) - 1
    known = dict(enumerate(leaves, first))
    level = 0
    while n > 1:
        low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, n)
        known |= {i: fetched[level, i] for i in (*range(low, first), *range(last + 1, high))}
        out.append(known)
        known = {i // ARITY: digest([known[j] for j in range(i, min(i + ARITY, n))]) for i in range(low, high, ARITY)}
        first, last, n, level = first // ARITY, last // ARITY, -(-n // ARITY), level + 1
    return [*out, known]


def path(idx: int, n: int, above: list[dict[int, str]]) -> list[tuple[int, list[str]]]:
    """A leaf's proof: on each level its place in its run, and the run's other members."""
    out = []
    for known in above[:-1]:
        low = idx // ARITY * ARITY
        run = range(low, min(low + ARITY, n))
        out.append((idx - low, [known[i] for i in run if i != idx]))
        idx, n = idx // ARITY, -(-n // ARITY)
    return out


def fold(own: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for place, others in proof:
        own = digest([*others[:place], own, *others[place:]])
    return own


def with_proofs(docs: DataFrame, claimed: Column, part_rows: int = PART_ROWS, step: int = STEP) -> DataFrame:
    """The manifest: one row for each row of ``docs``.

    doc_id, source, leaf, subroot, root, proof (array of the digests beside the
    leaf's path, via the subroot to the root, left to right), claimed (the leaf
    digest of the row with ``claimed`` as its text) and folded_root (where
    ``claimed`` leads with that proof).
    """
    own = {c.lower(): c for c in docs.columns}
    source = F.col(f"`{own['source']}`") if "source" in own else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), tree_name(source).alias("tree"),
        leaf(docs).alias("digest"), leaf(docs, claimed).alias("claimed"))
    leaves = stored(placed(rows, ["doc_id", "digest"]), "leaves")
    nodes = stored(nodes_above(leaves.select("tree", "idx", "digest", "n"), step), "tree")
    last = nodes.filter("n = 1")
    # the top tree: subroots in the order of their sources
    tops = last.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    tops = stored(placed(tops, ["of"]), "subroots")
    top_nodes = stored(nodes_above(tops.select("tree", "idx", "digest", "n"), step), "top")
    # leaf partitions and the coordinates that they miss, in both trees
    rows = leaves.withColumn("part", F.struct("part", F.floor(F.col("idx") / part_rows).alias("cut")))
    parts = rows.groupBy("tree", "part").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.first("n").alias("n"))
    parts = parts.join(tops.select(F.col("of").alias("tree"), F.col("idx").alias("top_idx"), F.col("n").alias("top_n")), "tree")
    coordinates = "array<struct<level:int,idx:bigint>>"

    @F.arrow_udf(coordinates)
    def lacking(first: pa.Array, last: pa.Array, n: pa.Array) -> pa.Array:
        found = [[{"level": a, "idx": b} for a, b in missing(*x)] for x in zip(first.to_pylist(), last.to_pylist(), n.to_pylist())]
        return pa.array(found, pa.list_(pa.struct([("level", pa.int32()), ("idx", pa.int64())])))

    wanted = parts.select("tree", "part", F.col("tree").alias("in"), F.explode(lacking("first", "last", "n")).alias("at")).unionByName(
        parts.select("tree", "part", F.lit(TOP).alias("in"), F.explode(lacking("top_idx", "top_idx", "top_n")).alias("at")))
    all_nodes = nodes.unionByName(top_nodes).select(F.col("tree").alias("in"), "level", "idx", F.col("digest"))
    wanted = wanted.select("tree", "part", "in", "at.level", "at.idx").join(all_nodes, ["in", "level", "idx"])
    fetched = wanted.groupBy("tree", "part").agg(F.collect_list(F.struct((F.col("in") == TOP).alias("top"), "level", "idx", "digest")).alias("fetched"))
    parts = stored(parts.join(fetched, ["tree", "part"], "left").select("tree", "part", "n", "top_idx", "top_n", "fetched"), "parts")
    proven = rows.select("tree", "part", "doc_id", "source", "idx", "digest", "claimed").groupBy("tree", "part").cogroup(
        parts.groupBy("tree", "part")).applyInArrow(
            _proofs, "doc_id long, source string, leaf string, subroot string, root string, proof array<string>, claimed string, folded_root string")
    return proven


def _proofs(rows: pa.Table, part: pa.Table) -> pa.Table:
    """The proofs of one leaf partition, from its own leaves and the nodes fetched for it."""
    rows = rows.sort_by("idx")
    info = part.select(["n", "top_idx", "top_n", "fetched"]).to_pylist()[0]
    fetched = [{(f["level"], f["idx"]): f["digest"] for f in info["fetched"] or () if f["top"] == top} for top in (False, True)]
    places, digests = rows.column("idx").to_pylist(), rows.column("digest").to_pylist()
    above = interiors(places[0], info["n"], digests, fetched[0])
    subroot = above[-1][0]
    over = interiors(info["top_idx"], info["top_n"], [subroot], fetched[1])
    shared = path(info["top_idx"], info["top_n"], over)
    proofs, folded = [], []
    for idx, claimed in zip(places, rows.column("claimed").to_pylist()):
        proof = path(idx, info["n"], above) + shared
        proofs.append([d for _, others in proof for d in others])
        folded.append(fold(claimed, proof))
    same = lambda value: pa.array([value] * len(places), pa.string())
    return pa.Table.from_arrays(
        [rows.column("doc_id"), rows.column("source"), rows.column("digest"), same(subroot), same(over[-1][0]),
         pa.array(proofs, pa.list_(pa.string())), rows.column("claimed"), pa.array(folded, pa.string())],
        names=["doc_id", "source", "leaf", "subroot", "root", "proof", "claimed", "folded_root"])
