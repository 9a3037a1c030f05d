"""Joins with a table of one row a key, where a few keys hold much of the probing side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; so there are at most 1 / share of them.
HOT_SHARE = 1 / 500
#: Keys that the frequency sketch tracks; its counts are off by at most about 3.5 / TRACKED of the rows.
TRACKED = 16_384


def key_hash(on: list[str]) -> Column:
    return F.xxhash64(*on)


def any_null(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))


def heavy_hitters(facts: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows of ``facts``.

    One pass with a frequency sketch per task (bounded, no shuffle of rows);
    at most ``1 / share`` numbers come to the driver.  Rows with a null in the
    key don't count.  The sketch's estimates never lie below the true count, so no hot key
    is missed; one that is slightly below the share may be among them.
    """
    most = int(1 / share) + 1
    keys = facts.filter(~any_null(on)).select(key_hash(on).alias("key"))
    found = keys.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(key, {most}, {TRACKED})").alias("top")).first()
    return [top["item"] for top in found["top"] or () if top["count"] > share * found["rows"]]


def hot_values(df: DataFrame, columns: dict[str, Column], share: float = HOT_SHARE) -> dict[str, list]:
    """For each named column, the values that more than ``share`` of the rows have; one pass, as in ``heavy_hitters``."""
    most = int(1 / share) + 1
    keys = df.select(*(c.alias(n) for n, c in columns.items()))
    found = keys.agg(F.count(F.lit(1)).alias("_rows"), *(
        F.expr(f"approx_top_k(`{n}`, {most}, {TRACKED})").alias(n) for n in columns)).first()
    return {n: [top["item"] for top in found[n] or () if top["item"] is not None and top["count"] > share * found["_rows"]]
            for n in columns}


def spread_join(df: DataFrame, table: DataFrame, probe: Column, key: str, values: list[str], hot: list, row_key: str = "row_key",
                hit: str | None = None) -> DataFrame:
    """``df`` and the ``values`` of the row of ``table`` whose ``key`` equals ``probe`` (null where there is none).

    For chains of joins, where reading ``df`` twice costs more than moving
    its hot rows.  Rows with a hot probe get their values from a broadcast of
    the hot keys' rows (at most ``len(hot)``, as ``table`` has one row a key);
    in the shuffle join for all others they, and rows with a null probe, carry
    a null key and the hash of ``row_key``, match nothing and are dealt evenly.
    ``hit`` names a further column: whether the probe has a row.
    """
    near, far, spread, rest, zero = "_near", "_far", "_spread", "_rest", "_zero"
    side = table.select(key, F.struct(*values, F.lit(True).alias("_hit")).alias("_v"))
    is_hot = F.coalesce(probe.isin(hot), F.lit(False)) if hot else F.lit(False)
    out = df.withColumn(rest, F.when(~is_hot, probe))
    out = out.withColumn(spread, F.when(F.col(rest).isNull(), F.xxhash64(row_key)).otherwise(F.lit(0)))
    cold = side.select(F.col(key).alias(far), F.col("_v").alias("_far_v"), F.lit(0).cast("long").alias(zero))
    out = out.join(cold, (F.col(rest) == F.col(far)) & (F.col(spread) == F.col(zero)), "left")
    found = F.col("_far_v")
    if hot:
        few = F.broadcast(side.filter(F.col(key).isin(hot)).select(F.col(key).alias(near), F.col("_v").alias("_near_v")))
        out = out.join(few, probe == F.col(near), "left")
        found = F.coalesce("_near_v", "_far_v")
    out = out.withColumn("_found", found)
    out = out.withColumns({v: F.col("_found")[v] for v in values} | ({hit: F.col("_found").isNotNull()} if hit else {}))
    return out.drop(rest, spread, far, "_far_v", zero, near, "_near_v", "_found")


def split_join(facts: DataFrame, table: DataFrame, on: list[str], how: str = "left", hot: list[int] | None = None,
               share: float = HOT_SHARE) -> DataFrame:
    """``facts`` joined (``left``, ``inner`` or ``left_semi``) with ``table``, whatever the frequencies of its keys.

    ``table`` has one row a key.  Rows of ``facts`` with a hot key meet a broadcast of the few rows of ``table`` that
    have one (at most ``1 / share``, a proven bound), so they stay where they
    are; all others are joined by a shuffle in which no key has more than the
    share.  Rows with a null in the key match nothing and meet nothing.

    ``hot`` are the hashes of hot keys (``heavy_hitters``), found here if not
    given.  ``facts`` is read once a branch and once for the sketch: give a
    stored or cheap table.  An empty table has no hot key.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"no split join of kind {how}")
    hot = heavy_hitters(facts, on, share) if hot is None else hot
    null = any_null(on)
    out = facts.columns + [c for c in table.columns if c not in on and how != "left_semi"]
    is_hot = key_hash(on).isin(hot) if hot else F.lit(False)
    rest = facts.filter(~null & ~is_hot).join(table, on, how).select(*out)
    if hot:
        few = F.broadcast(table.filter(is_hot))
        rest = rest.unionByName(facts.filter(~null & is_hot).join(few, on, how).select(*out))
    if how == "left":
        kinds = {f.name: f.dataType for f in table.schema}
        alone = facts.filter(null).select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in out[len(facts.columns):]))
        rest = rest.unionByName(alone)
    return rest
