"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from credo.llm.common import stored


def marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges`` written and read back, with their number and a sum of hashes taken in passing."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), total), "links")
    return out, seen.get


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (its smallest node) for each node in ``links`` (a, b).

    With ``rounds``, it stops early: what shares a component then is connected,
    but a component may still be in several parts.

    Each round connects every node's larger neighbours, then its smaller ones,
    to the smallest node around it; links end as stars after a logarithmic
    number of rounds.  All steps are joins and map-side combined minima.
    """
    edges, mark = marked(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before, done = None, 0
    while mark["n"] and done != rounds and (rounds is not None or mark != before):
        before = mark
        done += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges, mark = marked(small.unionByName(own).filter("u <> v").distinct())
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
