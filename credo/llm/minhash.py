"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct 5-word shingles.  Documents with the same
words are one class; a class is represented by its smallest id.  A sketch
holds the k smallest shingle hashes of a set.

Inverted lists of retained values generate overlaps.  Classes whose sets have
a Jaccard similarity of 3/4 share at least ``SHARED`` of ``K`` retained values
(but for a chance of about 2e-6 a pair at exactly 3/4, and less above), so a
class needs only its rarest ``K - SHARED + 1`` values as entries, and values
that stand in many unlike documents are rarely among them.  Where such lists
are still long, their members get larger sketches (``LONG_K``; whole sets,
mostly) with lists of their own, in which a class needs about a quarter of its
values; two classes that share only a passage then rarely meet.

Two classes that share a passage share all its lists; they meet only in those
before which their next rarer entries differ.  Inside a list, pairs are not expanded: members are compared with a few
leaders, first the one with the most common values, then a seeded choice that
grows ``GROWTH``-fold each round, and only if they are not known to be
connected yet.  Each pair of a list is thus either compared or in one
component, and a group of n copies costs about n comparisons.

Pairs are left out if their sizes differ too much, or their parity bits do:
each element of a set flips one of ``BITS`` bits, so the bits of two sets
differ in at most as many places as the sets.  In sets of some thousand
shingles several differences fall on one bit; the number of bits that differ is then
held against what is expected at 3/4, and members of long lists, where most pairs
meet, have ``LONG_BITS``.  A comparison then estimates the
similarity from the union of the two sketches; what passes is verified on the
full sets.  Shingles are compared by
64-bit hashes.

Null and empty texts have empty sets and no links.  Rows that share an id count
as one document.  A row without an id is linked with equal words only: with
those of a document, it belongs to that one's component and isn't kept; where
all rows with its words have no id, their component is null and one of them is
kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import fresh, give_back, held, stored, text_or_empty
from credo.llm.components import components
from credo.operators.skew import split_join

WORDS = 5
#: Values of a sketch that get lists, and how many of them similar sets share at least.
K, SHARED = 32, 12
#: The same for estimates, and for members of lists longer than ``LONG``.
ESTIMATE_K, ESTIMATE_SHARED = 64, 31
LONG, LONG_K, LONG_SHARED = 64, 512, 325
GROWTH = 16
#: Bits of a set's parity, a multiple of 64; more for members of long lists.
BITS, LONG_BITS = 512, 2048
#: Deviations by which the parities of similar sets may differ more than expected (a chance of about 1e-9).
DEVIATIONS = 6
#: Up to so many ids (16 MB) are broadcast to fetch their texts.
IDS_BROADCAST = 1_000_000
#: Words whose hash a worker remembers.
WORDS_KEPT = 300_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def hashes() -> Hashes:
    return held("shingle words", Hashes)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's set."""
    if not words:
        return np.empty(0, dtype=np.int64)
    known = hashes()
    h = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(WORDS, len(h))
    x = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i]
    # mixed, so that the smallest are a random choice
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((x + np.uint64(size)).view(np.int64))


def parity(found: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each of ``BITS`` residues occurs an odd number of times, as 64-bit integers; then the same for ``bits``, if more."""
    odd = (np.bincount((found.view(np.uint64) % np.uint64(k)).astype(np.int64), minlength=k) & 1 for k in sorted({BITS, bits}))
    return np.concatenate([np.packbits(x.astype(np.uint8)).view(np.int64) for x in odd])


def normal_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def sketches(docs: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """doc_id, same (equal for equal words; null for empty sets), n_shingles, sketch and odd of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, n, sketch, odd = [], [], [], []
            for text in batch.column(1):
                words = normal_words(text.as_py())
                found = shingles(words)
                same.append(xxhash.xxh128_hexdigest(b" ".join(words)) if words else None)
                n.append(len(found))
                sketch.append(found[:k])
                odd.append(parity(found, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.string()), pa.array(n, pa.int64()),
                 pa.array(sketch, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "same", "n_shingles", "sketch", "odd"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, same string, n_shingles long, sketch array<long>, odd array<long>")


def lists(classes: DataFrame, k: int, shared: int) -> DataFrame:
    """The inverted lists' entries of ``classes`` (node, n_shingles, sketch, odd).

    value, previous (the class's next rarer entry), node, n_shingles, odd, n
    (members of the list) and level (the round in which the entry leads the list).
    """
    classes = classes.select("node", "n_shingles", "odd", F.slice("sketch", 1, k).alias("sketch"))
    rows = classes.select("node", F.explode("sketch").alias("value"))
    counts = rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    hits = rows.join(counts, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("hits"))
    size = F.size("sketch")
    need = F.least(F.lit(shared), F.ceil(size * 0.75))
    # the values that no other class has are the rarest and need no entry
    room = size - need + 1 - (size - F.size("hits"))
    hub = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + F.least(h["df"], F.lit(1 << 20)))
    kept = hits.join(classes, "node").withColumns({"room": room.cast("int"), "hub": hub}).filter("room > 0")
    kept = kept.withColumn("hits", F.slice("hits", 1, F.col("room")))
    own = F.transform("hits", lambda h, i: F.struct(h["value"].alias("value"), F.get("hits", i - 1)["value"].alias("previous")))
    kept = kept.select("node", "n_shingles", "odd", "hub", F.inline(own))
    entries = stored(kept, "entries")
    first = entries.groupBy("value").agg(F.max(F.struct("hub", "node")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("value", "n", F.col("first.node").alias("leader"))
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)
    level = F.greatest(F.lit(1), F.ceil(F.log(float(GROWTH), F.greatest(draw * F.col("n"), F.lit(1e-9)))))
    level = F.when(F.col("node") == F.col("leader"), 0).otherwise(level.cast("int"))
    return entries.join(first, "value").select("value", "previous", "node", "n_shingles", "odd", "n", level.alias("level"))


def can_be_similar(n: Column, odd: Column, other_n: Column, other_odd: Column, bits: int = BITS) -> Column:
    """False only for pairs below 3/4, by sizes and parity bits (but for a chance of about 1e-9).

    Sets with a similarity of 3/4 differ in at most a seventh of the sum of
    their sizes; so many differences leave each of k bits odd with a chance of
    (1 - exp(-2 * differences / k)) / 2, and bits are odd less than
    independently.  ``bits`` over ``BITS`` follow those in ``odd`` and are
    looked at where the first don't decide.
    """
    most = (n + other_n) / 7

    def usual(k: int) -> Column:
        even = F.exp(most * (-2 / k))
        return F.least(most, (1 - even) * (k / 2) + F.sqrt(1 - even * even) * (DEVIATIONS * k ** 0.5 / 2))

    flipped = sum((F.bit_count(odd[i].bitwiseXOR(other_odd[i])) for i in range(BITS // 64)), F.lit(0))
    out = (F.least(n, other_n) * 4 >= F.greatest(n, other_n) * 3) & (flipped <= usual(BITS))
    if bits == BITS:
        return out
    more = (F.slice(x, BITS // 64 + 1, bits // 64) for x in (odd, other_odd))
    flips = F.zip_with(*more, lambda x, y: F.bit_count(x.bitwiseXOR(y)))  # so many terms in a row would not be compiled
    return out & (F.aggregate(flips, F.lit(0), lambda s, x: s + x) <= usual(bits))


def may_be_similar(left: str, right: str, k: int, shared: int) -> Column:
    """Whether the sketch of the union lets the sets be similar; exact for unions below ``k``."""
    union = F.slice(F.sort_array(F.array_union(left, right)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(left, right), union))
    return F.when(F.size(union) < k, both * 4 >= F.size(union) * 3).otherwise(both >= shared)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows of ``docs`` whose id is among the stored ``ids`` (node)."""
    if ids.count() <= IDS_BROADCAST:
        ids = F.broadcast(ids)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return docs.join(ids.withColumnRenamed("node", "doc_id"), "doc_id")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union of their full sets."""
    ids = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ids")
    texts = stored(texts_of(docs, ids), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, left, before = [], None, None
            for a, x, y in zip(batch.column("a"), batch.column("text_a"), batch.column("text_b")):
                if before is None or a != before:
                    left, before = shingles(normal_words(x.as_py())), a
                right = shingles(normal_words(y.as_py()))
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= 75 * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class Links:
    """Labels of the nodes that the links found so far connect: the smallest node around."""

    def __init__(self, docs: DataFrame, first: DataFrame):
        self.docs, self.labels, self.tested = docs, None, None
        if not first.isEmpty():
            self.connect(first)

    def labelled(self, df: DataFrame, node: str, label: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(label, F.col(node))
        known = self.labels.select(F.col("node").alias(node), F.col("component").alias(label))
        return df.join(known, node, "left").withColumn(label, F.coalesce(label, node))

    def add(self, entries: DataFrame, sketch: DataFrame, k: int, shared: int, bits: int = BITS) -> None:
        """Find the links between the members of each list (value, previous, node, n_shingles, odd, level).

        Two members with the same ``previous`` meet in that list; if it is left
        out as long, both are in the crowd.
        """
        last = entries.agg(F.max("level")).first()[0]
        for level in range(0, (last if last is not None else -1) + 1):
            members = self.labelled(entries.filter(F.col("level") >= level), "node", "c")
            if level:
                # lists whose members are all connected have nothing left to find
                mixed = members.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
                members = members.join(mixed.select("value"), "value", "left_semi")
            lead = members.filter(F.col("level") == level).select(
                "value", F.col("node").alias("leader"), F.col("c").alias("lc"), F.col("n_shingles").alias("ln"), F.col("odd").alias("lo"),
                F.col("previous").alias("lp"))
            met = members.join(lead, "value").filter("c <> lc and coalesce(previous <> lp, true)")
            met = met.filter(can_be_similar(F.col("n_shingles"), F.col("odd"), F.col("ln"), F.col("lo"), bits))
            pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
            if self.tested is not None:
                pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
            pairs = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            pairs = pairs.join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
            pairs = stored(pairs.filter(may_be_similar("sa", "sb", k, shared)).select("a", "b"), "pairs")
            if pairs.isEmpty():
                continue
            self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
            new = stored(verified(pairs, self.docs).distinct(), "links")
            if not new.isEmpty():
                self.connect(new)

    def connect(self, new: DataFrame) -> None:
        """Give connected nodes a common label: the smallest node around."""
        edges = self.labelled(self.labelled(new, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = components(edges)
        if self.labels is None:
            self.labels = stored(merged, "labels")
            return
        both = self.labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("better")), "component", "left")
        both = both.select("node", F.coalesce("better", "component").alias("component"))
        new_nodes = merged.join(self.labels.select("node"), "node", "left_anti")
        self.labels = stored(both.unionByName(new_nodes.select("node", "component")), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and same for each row of ``docs`` (doc_id, text).

    ``same`` is equal for equal words, and null for empty sets.
    """
    # the number tells equal rows apart
    rows = stored(sketches(docs, ESTIMATE_K).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = rows.filter("same is not null").groupBy("same").agg(
        F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.count("*").alias("rows"), F.min("row").alias("row"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"))
    every = stored(classes, "classes")
    classes = every.filter("node is not null")
    # rows that share an id hang together
    other = rows.filter("same is not null").join(classes.select("same", "node"), "same").filter("doc_id <> node")
    other = other.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(classes.select(F.col("node").alias("a")), "a", "left_semi")
    links = Links(docs, stored(other.distinct(), "links"))
    entries = stored(lists(classes, K, SHARED), "lists")
    links.add(entries.filter(F.col("n") <= LONG), classes.select("node", "sketch"), ESTIMATE_K, ESTIMATE_SHARED)
    crowd = stored(entries.filter(F.col("n") > LONG).select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        large = sketches(texts_of(docs, crowd), LONG_K, LONG_BITS).withColumnRenamed("doc_id", "node")
        large = large.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "sketch", "odd")))
        large = stored(large, "crowd-sketches")
        links.add(stored(lists(large, LONG_K, LONG_SHARED), "lists"), large, LONG_K, LONG_SHARED, LONG_BITS)
    copies = classes.filter("last > node or rows > 1").select("same", "node")
    full = split_join(rows.select("doc_id", "same", "n_shingles", "row"), copies, ["same"])
    full = links.labelled(full.withColumn("node", F.coalesce("node", "doc_id")), "node", "component")
    nameless = every.filter("node is null").select("row", F.lit(True).alias("first"))
    full = full.join(nameless, "row", "left")
    found = F.col("component")
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == found).otherwise(F.col("same").isNull() | F.col("first").isNotNull())
    return full.select("doc_id", "n_shingles", found.alias("component_id"), kept.alias("kept"), "same")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id."""
    found = stored(near_duplicates(docs), "near")
    drop = stored(found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "drop")
    twice = stored(found.filter("kept").groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("id")), "twice")
    key = F.col("doc_id").cast("long")
    if drop.count() <= IDS_BROADCAST:
        drop = F.broadcast(drop)
    rest = docs.filter(key.isNotNull()).join(drop, key == F.col("id"), "left_anti")
    if not twice.isEmpty():
        again = fresh("_id", docs.columns)
        many = rest.withColumn(again, key).join(twice, F.col(again) == F.col("id"), "left_semi").dropDuplicates([again]).drop(again)
        rest = rest.join(twice, key == F.col("id"), "left_anti").unionByName(many)
    nameless = docs.filter(key.isNull())
    if nameless.isEmpty():
        return rest
    number = fresh("_row", docs.columns)
    nameless = stored(nameless.withColumn(number, F.monotonically_increasing_id()), "nameless")
    words = stored(sketches(nameless.select(F.col(number).alias("doc_id"), "text"), 1).select(F.col("doc_id").alias("row"), "same"), "words")
    first = words.filter("same is not null").groupBy("same").agg(F.min("row").alias("row"))
    first = first.join(found.filter("doc_id is not null").select("same").distinct(), "same", "left_anti").select("row")
    first = stored(first.unionByName(words.filter("same is null").select("row")), "first")
    return rest.unionByName(nameless.join(first, F.col(number) == F.col("row"), "left_semi").drop(number))
