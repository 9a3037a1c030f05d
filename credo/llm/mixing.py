"""Mixing sources to target weights by capped water-filling.

Each source's target is its share, by weight, of all words, but at most
``max_epochs`` times its own size; what a clamped source can't take is shared
again, by weight, among the others until no target is above its limit.

A source then takes each document whole as often as target / size has ones,
and once more for documents in the order of a seeded hash of their ids while
their words come nearest to the rest of the target.  Rows with one id are
taken together.  The cut is found in two steps, by hash prefix and then inside
one prefix, so no source is gathered in one task.

Null texts have no words; a null source is a source of its own, the last one;
a null id hashes like the empty text.  Sources without words have the target
0, and their documents aren't taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credo.llm.common import WORD, fresh, stored, text_or_empty

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hex digits of the hash by which sizes are summed first.
PREFIX = 4


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def draw(doc_id: str, seed: str) -> Column:
    """The place of a document in its source's seeded order."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Weights go to the sources in code point order, repeating.  Only the level
    (target per weight), one number, visits the driver between rounds.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # rows: sources, not documents
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(by_source.select("source", "source_size", share.alias("weight")), "mix-sources")
    limit = F.col("source_size") * max_epochs
    level = 0.0
    clamped = -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(over).alias("over"),
        ).first()
        if not row["weight"] or row["over"] == clamped:
            break
        clamped = row["over"]
        level = (row["all"] - row["taken"]) / row["weight"]
    return table.select("source", "source_size", F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def cuts(sized: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` with ``whole`` repetitions and ``cut``: ids that hash up to it are taken once more.

    ``sized``: source, size and draw of each document.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = table.withColumn("whole", F.floor(ratio).cast("long"))
    table = table.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    slim = table.select(F.col("source").alias("s"), "want")
    same = F.col("source").eqNullSafe(F.col("s"))
    by_prefix = sized.groupBy("source", F.substring("draw", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("source").orderBy("prefix")
    by_prefix = by_prefix.withColumn("before", F.sum("size").over(so_far) - F.col("size")).join(slim, same)
    inside = by_prefix.filter("before <= want and want < before + size").select("source", "prefix", "before", "want")
    edge = inside.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "before", "want")
    rows = sized.groupBy("source", "draw").agg(F.sum("size").alias("size"))
    rows = rows.join(edge, same & (F.substring("draw", 1, PREFIX) == F.col("p")))
    at = Window.partitionBy("source").orderBy("draw")
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(at) - F.col("size") / 2)
    last = rows.filter(F.col("upto") <= F.col("want")).groupBy("source").agg(F.max("draw").alias("last"))
    last = last.select(F.col("source").alias("s2"), "last")
    found = inside.join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
    found = found.select(F.col("source").alias("s"), F.coalesce("last", "prefix").alias("cut"))
    full = table.join(found, same, "left").drop("s")
    return full.withColumn("cut", F.when(F.col("want") > 0, F.col("cut"))).drop("want")


def repetitions(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns, and what those are called.

    size, source_size, target and times, how often the mix takes the document.
    Names that ``docs`` has already are lengthened.
    """
    names = {n: fresh(n, docs.columns) for n in ("size", "source_size", "target", "times")}
    draws, source, whole, cut = (fresh(f"_{n}", docs.columns) for n in ("draw", "source", "whole", "cut"))
    sized = stored(
        docs.select(F.col("source"), word_count("text").alias("size"), draw("doc_id", seed).alias("draw")), "mix-sizes"
    )
    table = stored(cuts(sized, targets(sized, weights, max_epochs)), "mix-cuts")
    table = table.select(
        F.col("source").alias(source), F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]), F.col("whole").alias(whole), F.col("cut").alias(cut),
    )
    rows = docs.withColumns({names["size"]: word_count("text"), draws: draw("doc_id", seed)})
    rows = rows.join(table, F.col("source").eqNullSafe(F.col(source)), "left")
    extra = F.when(F.col(draws) <= F.col(cut), 1).otherwise(0)
    rows = rows.withColumn(names["times"], (F.col(whole) + extra).cast("long"))
    return rows.drop(draws, source, whole, cut), names


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``."""
    rows, names = repetitions(docs, **settings)
    copy = fresh("_copy", rows.columns)
    times = F.col(names["times"]).cast("int")
    rows = rows.filter(times > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*docs.columns)
