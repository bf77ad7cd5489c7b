"""Views that join groups, history and dismissals: chips, composite lists, counters, detail summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.functions.labels import hex16, tint
from twinspan.operators import analytics
from twinspan.operators.ranking import with_ordinal


def session_floor(occurrences: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Occurrence rows (id, group_hash, path, ...) left after a session's dismissals (group_hash, path).

    A group whose rows got fewer and are under two goes; one that had no
    dismissal stays, however small.
    """
    left = occurrences.join(dismissed.select("group_hash", "path").distinct(), ["group_hash", "path"], "left_anti")
    before = occurrences.groupBy("id").agg(F.count("*").alias("n0"))
    kept = left.groupBy("id").agg(F.count("*").alias("n")).join(before, "id").filter("n >= 2 OR n = n0").select("id")
    return left.join(kept, "id", "left_semi")


def history_chip(groups: DataFrame, badges: DataFrame, chip: str) -> DataFrame:
    """Groups under a chip: all, or those whose hash is NEW or GREW in the badges (group_hash, kind); gone ones are no live groups."""
    if chip == "all":
        return groups
    if chip == "gone":
        return groups.limit(0)
    return groups.join(badges.filter(F.col("kind") == chip.upper()).select("group_hash").distinct(), "group_hash", "left_semi")


def composite_list(summary: DataFrame, occurrences: DataFrame, key: str, query: str = "", badges: DataFrame | None = None, chip: str = "all", pattern: str = "") -> DataFrame:
    """``id, n, ordinal``: groups sorted by a key, then narrowed by search, chip and path pattern.

    ``n`` counts the occurrences that match the pattern; groups without any
    drop out. Narrowing keeps the order, so it is done before the sort.
    """
    found = analytics.search(summary, occurrences, query)
    found = found if badges is None else history_chip(found, badges, chip)
    shown = analytics.include(occurrences, pattern).groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("shown"))
    found = found.join(shown, "id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    if pattern:
        found = found.filter("shown > 0")
    return analytics.sorted_groups(found, key).join(found.select("id", F.col("shown").alias("n")), "id")


def baseline_meta(pairs: DataFrame, scan_groups: DataFrame, first_seen: DataFrame) -> DataFrame:
    """``folder_hash, group_hash, first_seen, baseline_count, current_count`` of every group of each folder's newest scan.

    ``pairs`` has folder_hash, head and base; a group that the base lacks, or
    a folder without one, has the count 0.
    """
    counts = ["folder_hash", "group_hash", F.coalesce("occurrence_count", F.lit(0)).alias("n")]
    head = scan_groups.join(pairs.select("folder_hash", F.col("head").alias("scan_id")), "scan_id").select(*counts).withColumnRenamed("n", "current_count")
    base = scan_groups.join(pairs.select("folder_hash", F.col("base").alias("scan_id")), "scan_id").select(*counts).withColumnRenamed("n", "baseline_count")
    seen = first_seen.select("group_hash", F.col("first_at").alias("first_seen"))
    return head.join(base, ["folder_hash", "group_hash"], "left").join(seen, "group_hash", "left").select("folder_hash", "group_hash", "first_seen", F.coalesce("baseline_count", F.lit(0)).alias("baseline_count"), "current_count")


def detail_summary(meta: DataFrame) -> DataFrame:
    """``text`` of each row of :func:`baseline_meta`: the count, and how it moved since the baseline."""
    delta = F.col("current_count") - F.col("baseline_count")
    base = F.concat(F.col("current_count").cast("string"), F.lit(" occurrences"))
    moved = F.when(delta > 0, F.concat(F.lit(" · "), delta.cast("string"), F.lit(" new occurrences since baseline"))).when(delta < 0, F.concat(F.lit(" · "), (-delta).cast("string"), F.lit(" occurrences removed since baseline"))).otherwise("")
    return meta.select("folder_hash", "group_hash", F.concat(base, moved).alias("text"))


def toolbar_counts(summary: DataFrame) -> DataFrame:
    """``id, files, duplicated_lines`` of each group: distinct paths, and the lines all but one copy take."""
    span = F.greatest(F.col("first.end_line") - F.col("first.start_line") + 1, F.lit(0))
    return summary.select("id", "files", F.when(F.col("n") >= 2, span * (F.col("n") - 1)).otherwise(F.lit(0)).cast("bigint").alias("duplicated_lines"))


def review_counts(groups: DataFrame, dismissed: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: hashes that can be reviewed (active or dismissed), and how many of them have been."""
    live = groups.select("group_hash").unionByName(dismissed.select("group_hash")).filter("group_hash IS NOT NULL").distinct()
    seen = reviewed.select("group_hash").distinct().withColumn("seen", F.lit(True))
    return live.join(seen, "group_hash", "left").agg(F.count("*").alias("reviewable"), F.count("seen").alias("reviewed"))


def checked_or_all(occurrences: DataFrame, checked: DataFrame) -> DataFrame:
    """``group_id, path, line`` to open or copy: the checked rows (group_id, path, start_line) of a group, or all where none is."""
    keys = ["group_id", "path", "start_line"]
    marked = checked.select(*keys).distinct().withColumn("marked", F.lit(True))
    some = marked.select("group_id").distinct().withColumn("some", F.lit(True))
    both = occurrences.select(*keys).join(marked, keys, "left").join(some, "group_id", "left")
    return both.filter("some IS NULL OR marked").select("group_id", "path", F.greatest("start_line", F.lit(1)).alias("line"))


def alpha_spans(occurrences: DataFrame) -> DataFrame:
    """``group_id, path, start_line, end_line, spans``: the renamed names of each occurrence in order, with their colour slot.

    ``occurrences`` has the ranges and ``alpha``; equal ranges under several
    ids put their spans together.
    """
    keys = ["group_id", "path", "start_line", "end_line"]
    spans = occurrences.select(*keys, F.explode("alpha").alias("a")).select(*keys, "a.s", "a.e", "a.idx").distinct()
    cell = F.struct("s", "e", "idx", tint(F.col("idx")).alias("tint"))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("spans"))


def tier_partition(groups: DataFrame) -> DataFrame:
    """``id, tier, ordinal``: functions (B) before blocks (A), by hash within each."""
    rank = F.when(F.col("tier") == "B", 0).otherwise(1)
    return with_ordinal(groups.select("id", "tier", rank.alias("r"), hex16(F.col("group_hash")).alias("h")), [F.col("r"), F.col("h"), F.col("id")]).select("id", "tier", "ordinal")


def provisional_views(groups: DataFrame) -> DataFrame:
    """``id`` (negative, in order of hash), ``group_hash, tier, n``: groups shown before the store has given them ids."""
    ranked = with_ordinal(groups.select("group_hash", "tier", F.col("occurrence_count").alias("n"), F.col("id").alias("old"), hex16(F.col("group_hash")).alias("h")), [F.col("h"), F.col("old")])
    return ranked.select((-F.col("ordinal")).alias("id"), "group_hash", "tier", "n")
