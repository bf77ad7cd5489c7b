"""Queries of the general problems: intervals (2) and snapshots (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.paths import canonical_path
from twinspan.operators.intervals import merge_intervals
from twinspan.operators.snapshots import snapshot_diff
from twinspan.sources.tables import table

#: canonical_path() in DuckDB, of a column named path.
CANONICAL_SQL = r"""CASE WHEN replace(path, chr(92), '/') LIKE '/%' AND regexp_replace('/' || replace(path, chr(92), '/'), '(/[.]?)+(/|$)', '\2', 'g') || '/' LIKE '/srv/checkout/%'
 THEN substr(regexp_replace('/' || replace(path, chr(92), '/'), '(/[.]?)+(/|$)', '\2', 'g'), 15)
 ELSE substr(regexp_replace('/' || replace(path, chr(92), '/'), '(/[.]?)+(/|$)', '\2', 'g'), 2) END"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = table(spark, sf_dir, "occurrences").select(canonical_path(F.col("path")).alias("path"), "start_line", "end_line")
    return merge_intervals(occ, "path", "start_line", "end_line")


P2_SQL = f"""
WITH o AS (SELECT {CANONICAL_SQL} AS path, least(start_line, end_line) AS s, greatest(start_line, end_line) AS e FROM occurrences
 WHERE path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
m AS (SELECT path, s, e, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT path, island, min(s) AS s, max(e) AS e FROM g GROUP BY path, island),
n AS (SELECT path, s, e, lead(s) OVER (PARTITION BY path ORDER BY s) AS nxt FROM p)
SELECT path, 'period' AS range_kind, s AS start_line, e AS end_line FROM n
UNION ALL SELECT path, 'gap', CAST(e + 1 AS INTEGER), CAST(nxt - 1 AS INTEGER) FROM n WHERE nxt IS NOT NULL
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(table(spark, sf_dir, "scans"), table(spark, sf_dir, "scan_groups"))


P3_SQL = """
WITH held AS (SELECT scan_id, group_hash, occurrence_count AS c, total_lines AS l FROM (
 SELECT *, row_number() OVER (PARTITION BY scan_id, group_hash ORDER BY ingested_at DESC NULLS LAST, occurrence_count DESC NULLS LAST, total_lines DESC NULLS LAST) AS rn FROM scan_groups) WHERE rn = 1),
snap AS (SELECT scan_id, lead(scan_id) OVER (PARTITION BY folder_hash ORDER BY started_at, scan_id) AS nxt, lag(scan_id) OVER (PARTITION BY folder_hash ORDER BY started_at, scan_id) AS prv
 FROM (SELECT DISTINCT scan_id, started_at, folder_hash FROM scans) WHERE scan_id IN (SELECT scan_id FROM scan_groups)),
new AS (SELECT h.* FROM held h JOIN snap s USING (scan_id) WHERE s.prv IS NOT NULL),
old AS (SELECT s.nxt AS scan_id, h.group_hash, h.c, h.l FROM held h JOIN snap s USING (scan_id) WHERE s.nxt IS NOT NULL),
a AS (SELECT * FROM new EXCEPT ALL SELECT * FROM old), b AS (SELECT * FROM old EXCEPT ALL SELECT * FROM new)
SELECT scan_id, group_hash, CASE WHEN bb IS NULL THEN 'added' WHEN aa IS NULL THEN 'removed' ELSE 'changed' END AS diff_kind
FROM (SELECT scan_id, group_hash, 1 AS aa FROM a) FULL JOIN (SELECT scan_id, group_hash, 1 AS bb FROM b) USING (scan_id, group_hash)
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL}
