"""Clean views of the stored tables, and joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.functions.labels import hex16, language_of, occurrence_label
from twinspan.functions.paths import canonical_path


def groups_view(match_groups: DataFrame) -> DataFrame:
    """One row per group id; of repeated rows the largest non-null values hold."""
    cols = ["group_hash", "tier", "occurrence_count", "total_lines", "total_tokens"]
    return match_groups.filter("id IS NOT NULL").groupBy("id").agg(*[F.max(c).alias(c) for c in cols])


def occurrences_view(occurrences: DataFrame) -> DataFrame:
    """Distinct ranges per group, under canonical paths, bounds in order.

    Rows without a group, path or line bound do not count.
    """
    return (
        occurrences.filter("group_id IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
        .groupBy("group_id", canonical_path(F.col("path")).alias("path"), F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"))
        .agg(F.min("start_byte").alias("start_byte"), F.min("end_byte").alias("end_byte"))
    )


def group_occurrences(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """group inner-joined with its occurrences."""
    return groups.join(occurrences, groups["id"] == occurrences["group_id"]).drop("group_id")


def list_groups(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every group with the independent minima of its paths and start lines."""
    firsts = occurrences.groupBy("group_id").agg(F.min("path").alias("first_path"), F.min("start_line").alias("first_line"))
    return groups.join(firsts, groups["id"] == firsts["group_id"], "left").select("id", "tier", "occurrence_count", "total_lines", "total_tokens", hex16(F.col("group_hash")).alias("hash"), "first_path", "first_line")


def group_totals(occurrences: DataFrame) -> DataFrame:
    """Per group: count, lines and bytes over all occurrences, severity.

    Lines per occurrence are never negative; null byte bounds add nothing.
    """
    lines = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    return occurrences.groupBy("group_id").agg(
        F.count("*").alias("occurrences"),
        F.count_distinct("path").alias("files"),
        F.sum(lines).cast("bigint").alias("lines"),
        F.coalesce(F.sum(F.col("end_byte") - F.col("start_byte")), F.lit(0)).cast("bigint").alias("bytes"),
        (F.count("*") * F.sum(lines)).cast("bigint").alias("severity"),
    )


def group_summary(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every group with ``n, lines, files, severity, first`` of its occurrences, label and language.

    Partial aggregates only; ``first`` is the least occurrence by path, lines
    and bytes. No view but the renderings needs more of a group.
    """
    lines = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    per = occurrences.groupBy("group_id").agg(
        F.count("*").alias("n"), F.sum(lines).alias("lines"), F.count_distinct("path").alias("files"), F.min(F.struct("path", "start_line", "end_line", "start_byte", "end_byte")).alias("first")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "lines", "files")]
    rest = [c for c in groups.columns if c not in ("n", "lines", "files", "first")]
    return (
        groups.join(per, groups["id"] == per["group_id"], "left")
        .select(*[groups[c] for c in rest], *zero, "first")
        .withColumn("severity", F.col("n") * F.col("lines"))
        .withColumn("language", language_of(F.col("first.path")))
        .withColumn("label", F.coalesce(occurrence_label(F.col("first.path"), F.col("first.start_line"), F.col("first.end_line")), F.lit("(empty group)")))
    )


def group_details(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every group with its occurrences as one sorted array, label and language, for renderings.

    A rendering is one document that names every occurrence of its group, so
    a row is as long as what it says; views use :func:`group_summary`.
    """
    nested = occurrences.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "end_line", "start_byte", "end_byte"))).alias("occurrences"))
    first = F.try_element_at("occurrences", F.lit(1))
    return (
        groups.join(nested, groups["id"] == nested["group_id"], "left")
        .drop("group_id")
        .withColumn("occurrences", F.coalesce("occurrences", F.array().cast("array<struct<path:string,start_line:int,end_line:int,start_byte:int,end_byte:int>>")))
        .withColumn("language", language_of(first["path"]))
        .withColumn("label", F.coalesce(occurrence_label(first["path"], first["start_line"], first["end_line"]), F.lit("(empty group)")))
    )
