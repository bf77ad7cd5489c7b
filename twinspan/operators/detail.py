"""Occurrences with their source lines: context, and where copies differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrence_lines(occurrences: DataFrame, corpus: DataFrame, context: int = 0) -> DataFrame:
    """One row per line of each occurrence: ``group_id, path, start_line, end_line, line, rel, text``.

    Lines are the pieces between line feeds, 1-based; ``rel`` is the line
    within the occurrence, from 0 (negative and beyond for context). Bounds
    are clamped to the file; a file without a text has no row. Occurrences
    meet the file's lines one by one, by path and line, so a path that many
    rows name is spread over the tasks.
    """
    texts = corpus.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")
    sizes = texts.select("path", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("size"))
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
    first, last = F.greatest(F.col("start_line") - context, F.lit(1)), F.least(F.col("end_line") + context, F.col("size"))
    kept = occurrences.select("group_id", "path", "start_line", "end_line").join(sizes, "path").filter(last >= first)
    wanted = kept.select("group_id", "path", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("line"))
    return wanted.join(lines, ["path", "line"]).select("group_id", "path", "start_line", "end_line", "line", (F.col("line") - F.col("start_line")).alias("rel"), "text")


def line_differences(lines: DataFrame) -> DataFrame:
    """``group_id, rel, texts, places, differs``: whether the n-th lines of a group's occurrences differ.

    A shorter occurrence stands for empty lines at its end.
    """
    members = lines.groupBy("group_id").agg(F.count_distinct("path", "start_line", "end_line").alias("members"))
    per = lines.filter("rel >= 0 AND line <= end_line").groupBy("group_id", "rel").agg(F.count("*").alias("places"), F.min("text").alias("lo"), F.max("text").alias("hi"))
    both = per.join(members, "group_id")
    short = F.col("places") < F.col("members")
    return both.select("group_id", "rel", "places", ((F.col("lo") != F.col("hi")) | short & (F.col("hi") != "")).alias("differs"))
