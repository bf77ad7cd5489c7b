"""Scan history: snapshots, differences, lineage, references."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.functions.labels import badge, classify, hex16


def scans_view(scans: DataFrame) -> DataFrame:
    """One row per scan id, the latest of its rows."""
    return scans.filter("scan_id IS NOT NULL").groupBy("scan_id").agg(F.max(F.struct("started_at", "folder_hash", "git_commit")).alias("s")).select("scan_id", "s.*")


def scan_groups_view(scan_groups: DataFrame) -> DataFrame:
    """Of several rows of a group in a scan, the one delivered last holds."""
    values = F.max(F.struct("ingested_at", "occurrence_count", "total_lines")).alias("v")
    return scan_groups.filter("scan_id IS NOT NULL AND group_hash IS NOT NULL").groupBy("scan_id", "group_hash").agg(values).select("scan_id", "group_hash", "v.occurrence_count", "v.total_lines")


def newest_scans(scans: DataFrame, count: int, *more: str) -> DataFrame:
    """The newest ``count`` scans of each folder with their rank, newest first.

    Top-k by folder and salt first, so no folder is one window.
    """
    newest = [F.desc("started_at"), F.desc("scan_id")]
    salted = scans.select("folder_hash", "scan_id", "started_at", *more, F.pmod(F.xxhash64("scan_id"), F.lit(64)).alias("salt"))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("folder_hash", "salt").orderBy(*newest))).filter(F.col("rank") <= count)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("folder_hash").orderBy(*newest))).filter(F.col("rank") <= count).drop("salt")


def head_and_base(scans: DataFrame, back: int = 1) -> DataFrame:
    """Per folder the newest scan and the one ``back`` before it (null where none)."""
    return newest_scans(scans, back + 1).groupBy("folder_hash").agg(
        F.max(F.when(F.col("rank") == 1, F.col("scan_id"))).alias("head"), F.max(F.when(F.col("rank") == back + 1, F.col("scan_id"))).alias("base")
    )


def diff(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two count tables; unchanged counts drop out."""
    b = base.select(*keys, F.coalesce("occurrence_count", F.lit(0)).alias("base_count"))
    h = head.select(*keys, F.coalesce("occurrence_count", F.lit(0)).alias("head_count"))
    both = b.join(h, keys, "full").select(*keys, F.coalesce("base_count", F.lit(0)).alias("base_count"), F.coalesce("head_count", F.lit(0)).alias("head_count"))
    return both.withColumn("kind", classify(F.col("base_count"), F.col("head_count"))).filter("kind <> 'UNCHANGED'").withColumn("badge", badge(F.col("base_count"), F.col("head_count")))


def latest_diff(scans: DataFrame, scan_groups: DataFrame) -> DataFrame:
    """Newest scan of each folder against the one before."""
    pairs = head_and_base(scans).filter("base IS NOT NULL")
    base = scan_groups.join(pairs.select("folder_hash", F.col("base").alias("scan_id")), "scan_id")
    head = scan_groups.join(pairs.select("folder_hash", F.col("head").alias("scan_id")), "scan_id")
    return diff(base, head, ["folder_hash", "group_hash"]).withColumn("hash", hex16(F.col("group_hash")))


def diff_text(rows: DataFrame) -> DataFrame:
    """One report line per difference."""
    delta = (
        F.when(F.col("kind") == "NEW", F.concat(F.lit("+"), F.col("head_count").cast("string")))
        .when(F.col("kind") == "GONE", F.concat(F.lit("-"), F.col("base_count").cast("string")))
        .when(F.col("kind") == "GREW", F.concat(F.lit("↑"), (F.col("head_count") - F.col("base_count")).cast("string")))
        .otherwise(F.concat(F.lit("↓"), (F.col("base_count") - F.col("head_count")).cast("string")))
    )
    return rows.select("folder_hash", F.concat(F.rpad("kind", 6, " "), F.lit("  "), "hash", F.lit("  "), F.col("base_count").cast("string"), F.lit("→"), F.col("head_count").cast("string"), F.lit("  "), delta).alias("line"))


def lineage(scans: DataFrame, scan_groups: DataFrame) -> DataFrame:
    """Every appearance of every group, with its scan."""
    return scan_groups.join(scans, "scan_id").select("group_hash", "scan_id", "started_at", "folder_hash", "git_commit", "occurrence_count", "total_lines")


def first_seen(scans: DataFrame, scan_groups: DataFrame) -> DataFrame:
    """Earliest and latest scan of each group."""
    rows = scan_groups.join(scans, "scan_id")
    at = F.struct("started_at", "scan_id")
    return rows.groupBy("group_hash").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("scans")).select(
        "group_hash", F.col("a.scan_id").alias("first_scan"), F.col("a.started_at").alias("first_at"), F.col("z.scan_id").alias("last_scan"), F.col("z.started_at").alias("last_at"), "scans"
    )


def scan_severity(scans: DataFrame, scan_groups: DataFrame) -> DataFrame:
    """Count times lines summed per scan; scans without groups have zero."""
    sums = scan_groups.groupBy("scan_id").agg(F.sum(F.col("occurrence_count") * F.col("total_lines")).alias("severity"), F.count("*").alias("groups"))
    return scans.join(sums, "scan_id", "left").select("scan_id", "folder_hash", "started_at", F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("groups", F.lit(0)).alias("groups"))


def sparkline(severity: DataFrame, points: int = 20) -> DataFrame:
    """The newest ``points`` scans per folder in order of time, scaled by the largest."""
    top = newest_scans(severity, points, "severity")
    folder = Window.partitionBy("folder_hash")
    return top.select(
        "folder_hash",
        "scan_id",
        F.row_number().over(folder.orderBy("started_at", "scan_id")).alias("point"),
        "severity",
        F.round(F.col("severity") / F.greatest(F.max("severity").over(folder), F.lit(1)), 6).alias("height"),
    )


# -- references to scans, resolved on the driver: each is one small lookup

_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_relative_date(token: str, now: int) -> int | None:
    """Seconds since the epoch of now, yesterday, or <n>m/h/d/w ago."""
    token = token.strip().lower()
    if token == "now":
        return now
    if token == "yesterday":
        return now - 86400
    m = re.fullmatch(r"(\d+)([mhdw])", token)
    return now - int(m[1]) * _UNITS[m[2]] if m else None


def _top(df: DataFrame) -> int | None:
    row = df.orderBy(F.desc("started_at"), F.desc("scan_id")).select("scan_id").first()
    return row[0] if row else None


def by_commit_prefix(scans: DataFrame, prefix: str) -> int | None:
    """Newest scan of a commit, at least four hex digits of it, any case."""
    if not re.fullmatch(r"[0-9A-Fa-f]{4,}", prefix):
        return None
    return _top(scans.filter(F.lower("git_commit").startswith(prefix.lower())))


def at_or_before(scans: DataFrame, seconds: int) -> int | None:
    return _top(scans.filter(F.col("started_at") <= seconds))


def resolve_since(scans: DataFrame, token: str, now: int) -> int | None:
    """A scan id, else a commit prefix, else a relative date."""
    token = token.strip()
    if re.fullmatch(r"-?\d{1,18}", token) and not scans.filter(F.col("scan_id") == int(token)).isEmpty():
        return int(token)
    found = by_commit_prefix(scans, token)
    if found is not None:
        return found
    seconds = parse_relative_date(token, now)
    return None if seconds is None else at_or_before(scans, seconds)


def resolve_baseline(scans: DataFrame, kind: str, now: int = 0, commit: str | None = None, scan_id: int | None = None) -> int | None:
    """last_scan, last_week, main_commit or pick; never the newest scan."""
    head = _top(scans)
    rest = scans.filter(F.col("scan_id") != head) if head is not None else scans.limit(0)
    if kind == "last_scan":
        return _top(rest)
    if kind == "last_week":
        return _top(rest.filter(F.col("started_at") <= now - _UNITS["w"]))
    if kind == "main_commit":
        return None if commit is None else _top(rest.filter(F.col("git_commit") == commit))
    if kind == "pick":
        return _top(rest.filter(F.col("scan_id") == scan_id))
    raise ValueError(kind)
