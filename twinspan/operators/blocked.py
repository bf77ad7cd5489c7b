"""Ordered operators over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into
blocks of its order key, each block is one window group, and only one row per
block takes part in the window over the whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B, _C = "__block", "__carry"


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    left, right = df.alias("l"), blocks.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*keys, _B]])
    return left.join(right, on, "left").select("l.*", F.col(f"r.{_C}"))


def blocked_running_sum(df: DataFrame, keys: list[str], order: str, value: str, block: Column, out: str) -> DataFrame:
    """Running sum of ``value`` by ``order`` (unique within the keys)."""
    cut = df.withColumn(_B, block)
    totals = cut.groupBy(*keys, _B).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, _B, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(_C))
    within = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _join_blocks(cut, carry, keys).withColumn(out, F.sum(value).over(within) + F.col(_C)).drop(_B, _C)


def blocked_lead(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str) -> DataFrame:
    """The next row's ``value``; ``block`` must not fall along ``order``."""
    cut = df.withColumn(_B, block)
    firsts = cut.groupBy(*keys, _B).agg(F.min(F.struct(*order, F.col(value).alias("__v"))).alias("__first"))
    carry = firsts.select(*keys, _B, F.lead("__first.__v").over(Window.partitionBy(*keys).orderBy(_B)).alias(_C))
    within = Window.partitionBy(*keys, _B).orderBy(*order)
    return _join_blocks(cut, carry, keys).withColumn(out, F.coalesce(F.lead(value).over(within), F.col(_C))).drop(_B, _C)
