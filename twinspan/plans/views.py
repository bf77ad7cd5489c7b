"""Queries of the joined views, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.labels import blob_hash, completion_banner, tier_label
from twinspan.functions.paths import canonical_path
from twinspan.operators import history, views
from twinspan.operators.ranking import with_ordinal
from twinspan.plans.general import CANONICAL_SQL
from twinspan.plans.reference import CTE, DETAIL, DIFF, HEADBASE, HEX, ISSUES, TIES, _groups, _issues, _occurrence_suppressions, _occurrences, _scan_groups, _scans, _summary, _suppressions
from twinspan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: DIFF and DETAIL both begin with the common table expressions.
DETAIL_TAIL = DETAIL[len(CTE) :].rstrip()


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _badges(spark, d):
    return history.latest_diff(_scans(spark, d), _scan_groups(spark, d)).select("group_hash", "kind")


@query(DIFF + DETAIL_TAIL + " SELECT id, 'new' AS chip FROM d WHERE group_hash IN (SELECT group_hash FROM df WHERE kind = 'NEW') UNION ALL SELECT id, 'grew' FROM d WHERE group_hash IN (SELECT group_hash FROM df WHERE kind = 'GREW')")
def history_chips(spark, d):
    groups, badges = _groups(spark, d), _badges(spark, d)
    return views.history_chip(groups, badges, "new").select("id", F.lit("new").alias("chip")).unionByName(views.history_chip(groups, badges, "grew").select("id", F.lit("grew").alias("chip")))


@query(
    DIFF
    + DETAIL_TAIL
    + f", sh AS (SELECT group_id, count(*) AS n FROM o WHERE regexp_matches(path, '/src/', 'i') GROUP BY group_id) SELECT d.id, sh.n, row_number() OVER (ORDER BY severity DESC, lower(coalesce(first_path, '')), {TIES.replace(', id', ', d.id')}) AS ordinal FROM d JOIN sh ON sh.group_id = d.id WHERE (contains(lower(label), 'a') OR contains(lower(language), 'a') OR d.id IN (SELECT group_id FROM o WHERE contains(lower(path), 'a'))) AND group_hash IN (SELECT group_hash FROM df WHERE kind = 'GREW')"
)
def composite_list(spark, d):
    return views.composite_list(_summary(spark, d), _occurrences(spark, d), "severity", "A", _badges(spark, d), "grew", "/src/")


_META = (
    CTE
    + HEADBASE
    + ", fs AS (SELECT group_hash, min(started_at) AS first_seen FROM sg JOIN sc USING (scan_id) GROUP BY group_hash), bm AS (SELECT hb.folder_hash, h.group_hash, fs.first_seen, coalesce(b.occurrence_count, 0) AS baseline_count, coalesce(h.occurrence_count, 0) AS current_count FROM hb JOIN sg h ON h.scan_id = hb.head LEFT JOIN sg b ON b.scan_id = hb.base AND b.group_hash = h.group_hash LEFT JOIN fs ON fs.group_hash = h.group_hash) "
)


def _meta(spark, d):
    scans, rows = _scans(spark, d), _scan_groups(spark, d)
    return views.baseline_meta(history.head_and_base(scans), rows, history.first_seen(scans, rows))


@query(_META + "SELECT * FROM bm")
def baseline_meta(spark, d):
    return _meta(spark, d)


@query(_META + "SELECT folder_hash, group_hash, current_count || ' occurrences' || CASE WHEN current_count > baseline_count THEN ' · ' || (current_count - baseline_count) || ' new occurrences since baseline' WHEN current_count < baseline_count THEN ' · ' || (baseline_count - current_count) || ' occurrences removed since baseline' ELSE '' END AS text FROM bm")
def detail_summary(spark, d):
    return views.detail_summary(_meta(spark, d))


@query(DETAIL + "SELECT id, files, CAST(CASE WHEN n >= 2 THEN greatest(first_end - first_start + 1, 0) * (n - 1) ELSE 0 END AS BIGINT) AS duplicated_lines FROM d")
def toolbar_counts(spark, d):
    return views.toolbar_counts(_summary(spark, d))


@query(CTE + ", l AS (SELECT group_hash FROM g WHERE group_hash IS NOT NULL UNION SELECT group_hash FROM su) SELECT count(*) AS reviewable, count(*) FILTER (group_hash IN (SELECT group_hash FROM sg)) AS reviewed FROM l")
def review_counts(spark, d):
    """Hashes that any scan has recorded stand for the reviewed ones."""
    return views.review_counts(_groups(spark, d), _suppressions(spark, d), _scan_groups(spark, d))


@query(
    CTE
    + ", k AS (SELECT DISTINCT group_id FROM o WHERE path LIKE '%.py') SELECT group_id, path, greatest(start_line, 1) AS line FROM o WHERE group_id NOT IN (SELECT group_id FROM k) OR path LIKE '%.py'"
)
def open_targets(spark, d):
    """The Python files of a group stand for the checked rows."""
    occ = _occurrences(spark, d)
    return views.checked_or_all(occ, occ.filter("path LIKE '%.py'"))


@query(
    CTE
    + ", v AS (SELECT g.id, g.group_hash, o.path, o.start_line, o.end_line FROM g JOIN o ON o.group_id = g.id), k AS (SELECT v.* FROM v ANTI JOIN os ON os.group_hash = v.group_hash AND os.file_path = v.path), c AS (SELECT id, count(*) AS n FROM k GROUP BY id), b AS (SELECT id, count(*) AS n0 FROM v GROUP BY id) SELECT k.id, k.path, k.start_line, k.end_line FROM k JOIN c USING (id) JOIN b USING (id) WHERE n >= 2 OR n = n0"
)
def session_view(spark, d):
    g, o = _groups(spark, d), _occurrences(spark, d)
    rows = g.join(o, g["id"] == o["group_id"]).select("id", "group_hash", "path", "start_line", "end_line")
    gone = _occurrence_suppressions(spark, d).select("group_hash", F.col("file_path").alias("path"))
    return views.session_floor(rows, gone).select("id", "path", "start_line", "end_line")


@query(
    f"WITH x AS (SELECT DISTINCT group_id, {CANONICAL_SQL} AS path, least(start_line, end_line) AS start_line, greatest(start_line, end_line) AS end_line, a.s AS s, a.e AS e, a.idx AS idx FROM (SELECT *, unnest(alpha) AS a FROM occurrences WHERE group_id IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL)) SELECT group_id, path, start_line, end_line, string_agg(s || '-' || e || ':' || idx || ':' || ((idx + 9) % 10), ' ' ORDER BY s, e, idx) AS spans FROM x GROUP BY ALL"
)
def alpha_spans(spark, d):
    rows = table(spark, d, "occurrences").filter("group_id IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    ranges = rows.select("group_id", canonical_path(F.col("path")).alias("path"), F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"), "alpha")
    told = F.transform("spans", lambda x: F.concat_ws(":", F.concat_ws("-", x["s"], x["e"]), x["idx"], x["tint"]))
    return views.alpha_spans(ranges).select("group_id", "path", "start_line", "end_line", F.array_join(told, " ").alias("spans"))


@query(CTE + f"SELECT id, tier, row_number() OVER (ORDER BY CASE WHEN tier = 'B' THEN 0 ELSE 1 END, {HEX.format('group_hash')} NULLS FIRST, id) AS ordinal FROM g")
def tier_partition(spark, d):
    return views.tier_partition(_groups(spark, d))


@query(CTE + f"SELECT -row_number() OVER (ORDER BY {HEX.format('group_hash')} NULLS FIRST, id) AS id, group_hash, tier, occurrence_count AS n FROM g")
def provisional_views(spark, d):
    return views.provisional_views(_groups(spark, d))


@query(ISSUES + "SELECT path, kind, message, row_number() OVER (ORDER BY path, kind, message NULLS FIRST) AS ordinal FROM i")
def issue_order(spark, d):
    rows = _issues(spark, d).filter("path IS NOT NULL AND kind IS NOT NULL").distinct()
    return with_ordinal(rows, [F.col("path"), F.col("kind"), F.col("message")])


@query(CTE + f"SELECT group_hash, sg.scan_id, row_number() OVER (ORDER BY {HEX.format('group_hash')}, started_at NULLS FIRST, sg.scan_id) AS ordinal FROM sg JOIN sc USING (scan_id)")
def lineage_order(spark, d):
    rows = history.lineage(_scans(spark, d), _scan_groups(spark, d)).select("group_hash", "scan_id", "started_at", F.lower(F.lpad(F.hex("group_hash"), 16, "0")).alias("h"))
    return with_ordinal(rows, [F.col("h"), F.col("started_at"), F.col("scan_id")]).select("group_hash", "scan_id", "ordinal")


@query(DIFF + f" SELECT folder_hash, group_hash, base_count, row_number() OVER (ORDER BY {HEX.format('group_hash')}, folder_hash NULLS FIRST) AS ordinal FROM df WHERE kind = 'GONE'")
def gone_order(spark, d):
    gone = history.latest_diff(_scans(spark, d), _scan_groups(spark, d)).filter("kind = 'GONE'").select("folder_hash", "group_hash", "base_count", "hash")
    return with_ordinal(gone, [F.col("hash"), F.col("folder_hash")]).drop("hash")


@query("SELECT DISTINCT id, CASE WHEN upper(tier) = 'B' THEN 'B' ELSE 'A' END AS tier, CASE WHEN length(hash_hex) = 16 THEN CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) END AS hash FROM (SELECT *, CAST(('0x' || hash_hex) AS UBIGINT)::HUGEINT AS u FROM match_groups WHERE hash_hex IS NOT NULL)")
def stored_hashes(spark, d):
    rows = table(spark, d, "match_groups").filter("hash_hex IS NOT NULL")
    return rows.select("id", tier_label(F.col("tier")).alias("tier"), blob_hash(F.unhex("hash_hex")).alias("hash")).distinct()


@query(DETAIL + "SELECT 'Scan complete — ' || count(*) || ' groups across ' || (SELECT count(DISTINCT path) FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) || ' files in 3.4s.' AS banner, (SELECT count(DISTINCT path) FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) AS files_scanned, count(*) AS groups FROM d")
def scan_counters(spark, d):
    files = table(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").agg(F.count_distinct("path").alias("files_scanned"))
    both = files.join(_groups(spark, d).agg(F.count("*").alias("groups")))  # one row each
    return both.select(completion_banner(F.col("groups"), F.col("files_scanned"), F.lit(3.4)).alias("banner"), "files_scanned", "groups")
