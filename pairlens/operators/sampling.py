"""Seeded positional sampling.

``seeded_positions`` gives every row a dense 0-based position inside its group in
``md5(seed|id)`` order plus the group size. Random picks then become equi-joins on
(group, position): linear work, no candidate scans, no per-group collect.

The position is built like a distributed zipWithIndex: rows are salted by the first
``salt_chars`` hex digits of their own md5 (so salt order == md5 order), per
(group, salt) counts are prefix-summed on the small count table, and a row_number
runs only inside one (group, salt) slice. A group holding a third of all rows is
split over up to 16^salt_chars tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.seeded import md5_int, md5_order


def _on(left: DataFrame, right: DataFrame, cols):
    return [left[c].eqNullSafe(right[c]) for c in cols]


def seeded_positions(df: DataFrame, group_cols: list[str], id_col: str, seed: int,
                     salt_chars: int = 2, pos_col: str = "_pos", size_col: str = "_n") -> DataFrame:
    h = md5_order(seed, id_col)
    d = df.withColumn("_h", h).withColumn("_salt", F.substr(F.col("_h"), F.lit(1), F.lit(salt_chars))
                                          if salt_chars > 0 else F.lit(""))
    counts = d.groupBy(*group_cols, "_salt").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*group_cols)
    offsets = counts.select(
        *group_cols, "_salt",
        F.coalesce(F.sum("_cnt").over(wg.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(wg).alias(size_col))  # one row per (group, salt)
    offsets = offsets.select([F.col(c).alias(f"_o_{c}") for c in [*group_cols, "_salt"]] + ["_off", size_col])
    cond = [d[c].eqNullSafe(offsets[f"_o_{c}"]) for c in [*group_cols, "_salt"]]
    joined = d.join(offsets, cond).drop(*[f"_o_{c}" for c in [*group_cols, "_salt"]])
    w = Window.partitionBy(*group_cols, "_salt").orderBy("_h", id_col)
    return joined.withColumn(pos_col, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint")).drop(
        "_h", "_salt", "_off")


def pick_position(seed: int, key_col: str, size: Column, offset: Column | int = 0) -> Column:
    """Position ``(md5_int(seed|key) + offset) mod size`` - a seeded uniform start."""
    return F.pmod(md5_int(seed, key_col) + offset, size)
