"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut into sections (at empty lines), paragraphs (lines) and pieces:
up to ``PIECE`` characters of a sentence, from its start, with its closing
marks.  A piece's hash covers its characters; a paragraph's, section's and the
root's hash cover their children's, so equal roots mean equal texts and, where
roots differ, following the differing children locates the edits.

A fingerprint is the tree as text::

    root:section{paragraph=piece,piece|paragraph=...}/section{...}

with the whole root hash, 16 digits for inner nodes, and for a piece 10 digits
and its length (two digits, hexadecimal).  The likeness of two fingerprints is
the Dice coefficient of their distinct pieces, weighted by length; two
fingerprints without pieces are alike (1.0).

Null texts count as empty, and an empty text is one empty paragraph.  In the
order of documents a null id comes first, and rows with one id go by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credo.llm.common import text_or_empty

PIECE = 48
PIECES = r"[^.!?]{1,48}[.!?]{0,9}|[.!?]{1,57}"
#: Documents of a bucket in which neighbours are found, and the most first
#: documents (16 bytes each) that are broadcast.
BUCKET_ROWS, FIRSTS_BROADCAST = 2000, 500_000


def hashed(children: Column) -> Column:
    return F.md5(F.array_join(children, ",").cast("binary"))


def tree(text: Column) -> Column:
    """root, sections of (hash, paragraphs of (hash, pieces)); a piece is 12 digits.

    The hash of a paragraph covers the whole hashes of its pieces.
    """

    def paragraph(line: Column) -> Column:
        full = F.transform(
            F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)),
            lambda p: F.concat(F.md5(p.cast("binary")), F.lpad(F.lower(F.hex(F.length(p))), 2, "0")),
        )
        return F.struct(
            hashed(full).alias("hash"),
            F.transform(full, lambda p: F.concat(F.substring(p, 1, 10), F.substring(p, 33, 2))).alias("pieces"),
        )

    def section(part: Column) -> Column:
        paragraphs = F.transform(F.split(part, "\n"), paragraph)
        return F.struct(hashed(paragraphs.getField("hash")).alias("hash"), paragraphs.alias("paragraphs"))

    sections = F.transform(F.split(text, "\n\n"), section)
    return F.struct(F.sha2(F.array_join(sections.getField("hash"), ","), 256).alias("root"), sections.alias("sections"))


def fingerprint(node: Column) -> Column:
    """A tree as text."""

    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["hash"], 1, 16), F.lit("="), F.array_join(p["pieces"], ","))

    def section(s: Column) -> Column:
        lines = F.array_join(F.transform(s["paragraphs"], paragraph), "|")
        return F.concat(F.substring(s["hash"], 1, 16), F.lit("{"), lines, F.lit("}"))

    return F.concat(node["root"], F.lit(":"), F.array_join(F.transform(node["sections"], section), "/"))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def pieces(print_: Column) -> Column:
    """The distinct pieces of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("[=,]([0-9a-f]{12})"), F.lit(1)))


def weight(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.conv(F.substring(p, 11, 2), 16, 10).cast("long"))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1, from two fingerprints' pieces."""
    both = weight(left) + weight(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * weight(F.array_intersect(left, right)) / both)


def differing(left: str, right: str) -> Column:
    """Where two fingerprints (columns) differ: section and paragraph numbers, from 0.

    Empty for equal roots; children are compared only below differing nodes.
    """

    def sections(c: str) -> Column:
        return F.split(F.substring(F.col(c), 66, 1 << 30), "/")

    def lines(s: Column) -> Column:
        return F.split(F.regexp_extract(F.coalesce(s, F.lit("")), r"\{(.*)\}", 1), r"\|")

    def numbers(a: Column, b: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)

    def below(i: Column) -> Column:
        x, y = F.get(sections(left), i), F.get(sections(right), i)
        a, b = lines(x), lines(y)
        changed = F.filter(numbers(a, b), lambda j: ~F.get(a, j).eqNullSafe(F.get(b, j)))
        found = F.transform(changed, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        return F.when(F.substring(x, 1, 16).eqNullSafe(F.substring(y, 1, 16)), F.slice(found, 1, 0)).otherwise(found)

    found = F.flatten(F.transform(numbers(sections(left), sections(right)), below))
    return F.when(root(F.col(left)) == root(F.col(right)), F.slice(found, 1, 0)).otherwise(found)


def with_next(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id long, text) with the columns ``more``, and ``next_<c>`` of text and of those.

    After the last document comes the first.  Buckets of id ranges are sorted
    each by itself; the first documents of each bucket are also sent to the
    bucket before.
    """
    ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, rows = ids[0] or 0, ids[1] or 0, ids[2]
    buckets = rows // BUCKET_ROWS + 1
    place = (F.col("doc_id").cast("double") - float(low)) / float(high - low + 1) * float(buckets)
    dealt = docs.withColumns({"bucket": F.least(F.coalesce(F.floor(place).cast("long"), F.lit(0).cast("long")), F.lit(buckets - 1)), "tail": F.lit(0)})
    order = Window.orderBy("bucket")  # rows: buckets, not documents
    firsts = dealt.select("bucket", "doc_id").groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"))
    firsts = firsts.select(
        F.col("first.doc_id").alias("id"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("before"))
    if buckets <= FIRSTS_BROADCAST:
        firsts = F.broadcast(firsts)
    tails = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("id"))).select(
        *docs.columns, F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    both = dealt.unionByName(tails).withColumns(more)
    by = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("text", *more)})
    return both.filter("tail = 0").drop("bucket", "tail")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text.

    doc_id, n_chars, edited (the text whose last half is replaced by as much
    of the next document's start), fingerprint, edited_fingerprint,
    near_edited and near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = with_next(rows, {"fingerprint": fingerprint(tree(F.col("text")))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(tree(F.col("edited"))))
    rows = rows.withColumns({"own": pieces(F.col("fingerprint")), "e": pieces(F.col("edited_fingerprint")), "x": pieces(F.col("next_fingerprint"))})
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("own"), F.col("e")).alias("near_edited"), likeness(F.col("own"), F.col("x")).alias("near_next"))
