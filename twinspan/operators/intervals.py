"""Covered periods and gaps of integer intervals by a sweep line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspan.operators.blocked import blocked_lead, blocked_running_sum

#: Positions of one group that one window task sorts at most.
BLOCK_BITS = 16


def merge_intervals(df: DataFrame, key: str, lo: str, hi: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Periods covered by the inclusive intervals of each key, and the gaps.

    Result: ``key, range_kind ('period' or 'gap'), <lo>, <hi>`` with the types
    of the input bounds. Defined cases: a row with a null key or a null bound
    does not count; reversed bounds are put right; repeated rows change
    nothing; intervals that touch are continuous; an empty table gives none;
    other columns of the input are ignored, whatever their names.

    Plan: plus and minus events are added up per (key, position) before the
    shuffle, so a hot key costs its distinct boundaries, not its rows; the
    prefix sums run in blocks of positions with carried totals.
    """
    bounds = df.select(F.col(key).alias("k"), F.least(lo, hi).cast("bigint").alias("lo"), F.greatest(lo, hi).cast("bigint").alias("hi"), (F.col(lo).isNotNull() & F.col(hi).isNotNull() & F.col(key).isNotNull()).alias("ok")).filter("ok")
    hashed = bounds.schema["k"].dataType == T.StringType()
    keys = ["k0", "k1"] if hashed else ["k0"]
    # long names travel as 128-bit hashes and come back at the end
    named = bounds.select(*([F.xxhash64("k").alias("k0"), F.xxhash64(F.lit(1), "k").alias("k1")] if hashed else [F.col("k").alias("k0")]), "k", "lo", "hi")
    events = (
        named.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("p"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*keys, F.col("e.p").alias("p"))
        .agg(F.sum("e.d").alias("d"))
        .filter("d <> 0")
    )
    block = F.shiftright("p", block_bits)
    active = blocked_running_sum(events, keys, "p", "d", block, "active")
    edges = active.filter((F.col("active") == 0) | (F.col("active") == F.col("d"))).select(*keys, "p", (F.col("active") > 0).alias("on"))
    spans = blocked_lead(edges, keys, ["p"], "p", block, "nxt").filter(F.col("nxt").isNotNull())
    if hashed:
        spans = spans.join(named.groupBy(*keys).agg(F.min("k").alias("k")), keys)
    else:
        spans = spans.withColumnRenamed("k0", "k")
    types = dict(df.select(lo, hi).dtypes)
    return spans.select(
        F.col("k").alias(key),
        F.when(F.col("on"), "period").otherwise("gap").alias("range_kind"),
        F.col("p").cast(types[lo]).alias(lo),
        (F.col("nxt") - 1).cast(types[hi]).alias(hi),
    )
