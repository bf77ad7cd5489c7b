"""Reuse of stored fingerprints: what an incremental run must do again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_fingerprints(file_blocks: DataFrame) -> DataFrame:
    """One row per path: the newest by modification time, the largest hash among equals."""
    newest = F.max(F.struct("mtime", "content_hash", "size", "block_hashes")).alias("v")
    return file_blocks.filter("path IS NOT NULL").groupBy("path").agg(newest).select("path", "v.content_hash", "v.size", "v.mtime", "v.block_hashes")


def plan_run(corpus: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``path, action``: reuse (same size, blocks present), recompute (changed), compute (new), drop (gone)."""
    now = corpus.filter("path IS NOT NULL AND text IS NOT NULL").groupBy("path").agg(F.max(F.octet_length("text")).alias("bytes"))
    both = now.join(fingerprints.select("path", "size", F.col("block_hashes").isNotNull().alias("known")), "path", "full")
    action = F.when(F.col("bytes").isNull(), "drop").when(F.col("known").isNull(), "compute").when((F.col("bytes") == F.col("size")) & F.col("known"), "reuse").otherwise("recompute")
    return both.select("path", action.alias("action"))


def shared_blocks(fingerprints: DataFrame) -> DataFrame:
    """``path, blocks, shared``: how many of a file's distinct blocks stand in other files too.

    A block's files are told apart by the smallest and the largest path, so a
    block that every file has costs one partial aggregate, not a pair list.
    """
    cells = fingerprints.select("path", F.explode("block_hashes").alias("h")).filter("h IS NOT NULL").distinct()
    common = cells.groupBy("h").agg(F.min("path").alias("a"), F.max("path").alias("z")).filter("a <> z").select("h", F.lit(1).alias("common"))
    return cells.join(common, "h", "left").groupBy("path").agg(F.count("*").alias("blocks"), F.count("common").alias("shared"))
