"""1-based ordinals over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan.session import cut


def with_ordinal(df: DataFrame, order: list[Column], out: str = "ordinal") -> DataFrame:
    """Adds the position of each row in ``order`` (which must be total).

    Rows are range-partitioned by the order; positions within partitions are
    shifted by the sizes of the partitions before, which are as many numbers
    as there are partitions.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    placed = cut(keyed.repartitionByRange(*[_plain(keyed, k, c) for k, c in zip(keys, order, strict=True)]).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__p").orderBy(*[_plain(placed, k, c) for k, c in zip(keys, order, strict=True)])
    ranked = placed.withColumn("__r", F.row_number().over(within)).join(F.broadcast(before), "__p")
    return ranked.withColumn(out, F.col("__r") + F.col("__before")).drop("__p", "__r", "__before", *keys)


def _plain(df: DataFrame, key: str, _: Column) -> Column:
    return df[key]
