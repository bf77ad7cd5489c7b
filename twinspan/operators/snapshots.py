"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.blocked import blocked_lead

#: Seconds of started_at in one block of the snapshot order.
BLOCK_SECONDS = 30 * 86400


def consecutive_snapshots(scans: DataFrame, rows: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``scan_id, next_scan_id`` of the scans that have rows, per folder.

    Order: ``started_at``, then ``scan_id`` (a null start comes first). A scan
    id listed with several starts counts once, with its latest. A null folder
    is a folder of its own.
    """
    known = scans.filter("scan_id IS NOT NULL").groupBy("scan_id").agg(F.max(F.struct("started_at", "folder_hash")).alias("s")).select("scan_id", "s.*")
    seen = rows.select("scan_id").distinct()
    snaps = known.join(seen, "scan_id", "left_semi").withColumn("at", F.coalesce("started_at", F.lit(-(1 << 62))))
    block = F.floor(F.col("at") / block_seconds)
    return blocked_lead(snaps, ["folder_hash"], ["at", "scan_id"], "scan_id", block, "next_scan_id").select("scan_id", "next_scan_id")


def snapshot_diff(scans: DataFrame, rows: DataFrame, key: str = "group_hash", values: tuple[str, ...] = ("occurrence_count", "total_lines"), version: str = "ingested_at") -> DataFrame:
    """``scan_id, <key>, diff_kind``: added, removed or changed, under the later scan.

    Defined cases: of several rows of a key in one scan the one with the
    latest ``version`` holds (null oldest; among equal ones the largest
    values); rows of unknown or null scans and null keys do not count; null
    equals null in the values and differs from every number; the first
    snapshot of a folder gives nothing; empty tables give nothing.

    Plan: each held row stands once as the new side under its own scan and
    once as the old side under the next one. EXCEPT ALL in both directions is
    one signed count over whole rows (identical rows cancel, and the grouping
    is by all columns, so no scan or folder is hot); only the residue is
    full-joined by key.
    """
    pairs = consecutive_snapshots(scans, rows)
    held = (
        rows.filter(F.col("scan_id").isNotNull() & F.col(key).isNotNull())
        .groupBy("scan_id", F.col(key).alias("k"))
        .agg(F.max(F.struct(version, *values)).alias("v"))
        .select("scan_id", "k", *[F.col(f"v.{c}").alias(f"v{i}") for i, c in enumerate(values)])
    )
    cols = [f"v{i}" for i in range(len(values))]
    with_next = held.join(pairs, "scan_id")
    later = pairs.filter("next_scan_id IS NOT NULL").select(F.col("next_scan_id").alias("scan_id"))
    new = held.join(later, "scan_id", "left_semi").select("scan_id", "k", *cols, F.lit(1).alias("sign"))
    old = with_next.filter("next_scan_id IS NOT NULL").select(F.col("next_scan_id").alias("scan_id"), "k", *cols, F.lit(-1).alias("sign"))
    residue = new.unionByName(old).groupBy("scan_id", "k", *cols).agg(F.sum("sign").alias("n")).filter("n <> 0")
    added = residue.filter("n > 0").select("scan_id", "k", F.lit(1).alias("a"))
    gone = residue.filter("n < 0").select("scan_id", "k", F.lit(1).alias("r"))
    kind = F.when(F.col("r").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return added.join(gone, ["scan_id", "k"], "full").select("scan_id", F.col("k").alias(key), kind.alias("diff_kind"))
