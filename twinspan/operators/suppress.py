"""Dismissals: filters and table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppressions_view(suppressions: DataFrame) -> DataFrame:
    """One row per dismissed hash, the latest dismissal."""
    return suppressions.filter("group_hash IS NOT NULL").groupBy("group_hash").agg(F.max(F.struct("dismissed_at", "last_group_id")).alias("s")).select("group_hash", "s.dismissed_at", "s.last_group_id")


def without_suppressed_groups(df: DataFrame, suppressions: DataFrame) -> DataFrame:
    return df.join(suppressions.select("group_hash").distinct(), "group_hash", "left_anti")


def without_suppressed_occurrences(df: DataFrame, occurrence_suppressions: DataFrame, floor: int = 2) -> DataFrame:
    """Occurrence rows (group_hash, path, ...) left; groups under the floor go.

    The floor counts rows, by a partial aggregate and a semi join, so a large
    group is never one window.
    """
    pairs = occurrence_suppressions.select("group_hash", F.col("file_path").alias("path")).distinct()
    left = df.join(pairs, ["group_hash", "path"], "left_anti")
    kept = left.groupBy("group_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= floor).select("group_hash")
    return left.join(kept, "group_hash", "left_semi")


def dismissed_view(suppressions: DataFrame, groups: DataFrame, occurrence_suppressions: DataFrame) -> DataFrame:
    """Dismissed hashes with the live group's id (else the last known one) and their occurrence dismissals."""
    live = groups.groupBy("group_hash").agg(F.min("id").alias("live_id"))
    nested = occurrence_suppressions.groupBy("group_hash").agg(F.count("*").alias("occurrence_dismissals"), F.max("dismissed_at").alias("last_occurrence_dismissal"))
    return (
        suppressions.join(live, "group_hash", "left")
        .join(nested, "group_hash", "left")
        .select(
            "group_hash",
            "dismissed_at",
            F.coalesce("live_id", "last_group_id").alias("id"),
            F.col("live_id").isNotNull().alias("live"),
            F.coalesce("occurrence_dismissals", F.lit(0)).alias("occurrence_dismissals"),
            "last_occurrence_dismissal",
        )
    )


def dismiss(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace rows with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def undismiss(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the rows with these keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti")
