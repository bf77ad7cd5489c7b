"""Queries over the stored tables: groups, suppressions, history, analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.labels import dismissed_label, hex16, unix_date
from twinspan.functions.paths import canonical_path
from twinspan.operators import analytics, history, report, store, suppress
from twinspan.operators.ranking import with_ordinal
from twinspan.plans.general import CANONICAL_SQL
from twinspan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HEX = "lpad(lower(hex({})), 16, '0')"
CTE = f"""WITH g AS (SELECT id, max(group_hash) AS group_hash, max(tier) AS tier, max(occurrence_count) AS occurrence_count, max(total_lines) AS total_lines, max(total_tokens) AS total_tokens
 FROM match_groups WHERE id IS NOT NULL GROUP BY id),
o AS (SELECT group_id, {CANONICAL_SQL} AS path, least(start_line, end_line) AS start_line, greatest(start_line, end_line) AS end_line, min(start_byte) AS start_byte, min(end_byte) AS end_byte
 FROM occurrences WHERE group_id IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY 1, 2, 3, 4),
su AS (SELECT group_hash, max(dismissed_at) AS dismissed_at FROM suppressions WHERE group_hash IS NOT NULL GROUP BY group_hash),
os AS (SELECT g.group_hash, min(o.path) AS file_path, max(s.dismissed_at) AS dismissed_at FROM suppressions s JOIN g ON g.id = s.last_group_id JOIN o ON o.group_id = g.id GROUP BY g.group_hash),
sc AS (SELECT scan_id, max(started_at) AS started_at, max(folder_hash) AS folder_hash, max(git_commit) AS git_commit FROM scans WHERE scan_id IS NOT NULL GROUP BY scan_id),
sg AS (SELECT scan_id, group_hash, occurrence_count, total_lines FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, group_hash ORDER BY ingested_at DESC NULLS LAST, occurrence_count DESC NULLS LAST, total_lines DESC NULLS LAST) AS rn
 FROM scan_groups WHERE scan_id IS NOT NULL AND group_hash IS NOT NULL) WHERE rn = 1)
"""
LANG = "CASE lower(regexp_extract({0}, '[^/.][^/]*\\.([^./]+)$', 1)) WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TSX' END"
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY path, start_line, end_line, start_byte NULLS FIRST, end_byte NULLS FIRST) AS rn FROM o) WHERE rn = 1)"
DETAIL = (
    CTE
    + ", "
    + FIRST
    + f""", m AS (SELECT group_id, count(*) AS n, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines, count(DISTINCT path) AS files FROM o GROUP BY group_id),
d AS (SELECT g.*, coalesce(m.n, 0) AS n, coalesce(m.lines, 0) AS lines, coalesce(m.files, 0) AS files, coalesce(m.n, 0) * coalesce(m.lines, 0) AS severity, f.path AS first_path, f.start_line AS first_start, f.end_line AS first_end,
 coalesce(f.path || ':L' || f.start_line || '–' || f.end_line, '(empty group)') AS label, {LANG.format("f.path")} AS language
 FROM g LEFT JOIN m ON m.group_id = g.id LEFT JOIN f ON f.group_id = g.id)
"""
)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return store.groups_view(table(spark, d, "match_groups"))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return store.occurrences_view(table(spark, d, "occurrences"))


def _details(spark: SparkSession, d: str) -> DataFrame:
    return store.group_details(_groups(spark, d), _occurrences(spark, d))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return store.group_summary(_groups(spark, d), _occurrences(spark, d))


def _suppressions(spark: SparkSession, d: str) -> DataFrame:
    return suppress.suppressions_view(table(spark, d, "suppressions"))


def _occurrence_suppressions(spark: SparkSession, d: str) -> DataFrame:
    """Dismissed occurrences: the first file of each group that a suppression names by id."""
    g, o = _groups(spark, d), _occurrences(spark, d)
    named = table(spark, d, "suppressions").select(F.col("last_group_id").alias("id"), "dismissed_at")
    return g.join(named, "id").join(o, g["id"] == o["group_id"]).groupBy("group_hash").agg(F.min("path").alias("file_path"), F.max("dismissed_at").alias("dismissed_at"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return history.scans_view(table(spark, d, "scans"))


def _scan_groups(spark: SparkSession, d: str) -> DataFrame:
    return history.scan_groups_view(table(spark, d, "scan_groups"))


# -- groups


@query(CTE + f"SELECT g.id, tier, occurrence_count, total_lines, total_tokens, {HEX.format('group_hash')} AS hash, min(path) AS first_path, min(start_line) AS first_line FROM g LEFT JOIN o ON o.group_id = g.id GROUP BY ALL")
def list_groups(spark, d):
    return store.list_groups(_groups(spark, d), _occurrences(spark, d))


@query(
    CTE
    + "SELECT group_id, count(*) AS occurrences, count(DISTINCT path) AS files, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines, CAST(coalesce(sum(end_byte - start_byte), 0) AS BIGINT) AS bytes, CAST(count(*) * sum(end_line - start_line + 1) AS BIGINT) AS severity FROM o GROUP BY group_id"
)
def group_totals(spark, d):
    return store.group_totals(_occurrences(spark, d))


@query(
    CTE
    + "SELECT g.id, '--- [' || tier || '] group ' || g.id || ' (' || coalesce(occurrence_count, 0) || ' occurrences) ---' || coalesce(chr(10) || string_agg(path || ':' || start_line || '-' || end_line, chr(10) ORDER BY path, start_line, end_line), '') AS text FROM g LEFT JOIN o ON o.group_id = g.id GROUP BY g.id, tier, occurrence_count"
)
def show_text(spark, d):
    return report.group_text(_details(spark, d))


@query(
    CTE
    + f"""SELECT g.id, '{{"id":' || g.id || ',"ordinal":1,"tier":"' || tier || '","hash":"' || {HEX.format("group_hash")} || '",' || coalesce('"occurrence_count":' || occurrence_count || ',', '') || '"occurrences":[' ||
 coalesce(string_agg('{{"path":"' || path || '","start_line":' || start_line || ',"end_line":' || end_line || coalesce(',"start_byte":' || start_byte, '') || coalesce(',"end_byte":' || end_byte, '') || '}}', ',' ORDER BY path, start_line, end_line), '') || ']}}' AS json
FROM g LEFT JOIN o ON o.group_id = g.id GROUP BY g.id, tier, group_hash, occurrence_count"""
)
def show_json(spark, d):
    return report.group_json(_details(spark, d).withColumn("one", F.lit(1)), "one")


@query(
    CTE
    + f"""SELECT g.id, '{{"ruleId":"duplicate-block","level":"note","message":{{"text":"Duplicate block (' || coalesce(occurrence_count, 0) || ' occurrences, Tier ' || tier || ')"}},"partialFingerprints":{{"groupHash/v1":"' || {HEX.format("group_hash")} || '"}},"locations":[' ||
 coalesce(string_agg('{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || greatest(start_line, 1) || ',"endLine":' || greatest(end_line, start_line, 1) || '}}}}}}', ',' ORDER BY path, start_line, end_line), '') || ']}}' AS result
FROM g LEFT JOIN o ON o.group_id = g.id GROUP BY g.id, tier, group_hash, occurrence_count"""
)
def sarif_results(spark, d):
    return report.sarif_result(_details(spark, d))


@query(
    DETAIL
    + f"""SELECT d.id, CASE WHEN n = 0 THEN '' ELSE '{report.PROMPT_HEAD}' || n || ' ' || coalesce(language || ' ', '') || '{report.PROMPT_TAIL}' || chr(10) || chr(10) || b.body END AS prompt
FROM d LEFT JOIN (SELECT group_id, string_agg('- ' || path || ':' || start_line || '-' || end_line || chr(10), '' ORDER BY path, start_line, end_line) AS body FROM o GROUP BY group_id) b ON b.group_id = d.id"""
)
def refactor_prompts(spark, d):
    return report.prompt(_details(spark, d))


# -- suppressions


@query(
    CTE
    + ", v AS (SELECT g.id, g.group_hash, g.tier, o.path, o.start_line, o.end_line FROM g JOIN o ON o.group_id = g.id), k AS (SELECT v.* FROM v ANTI JOIN os ON os.group_hash = v.group_hash AND os.file_path = v.path), fl AS (SELECT group_hash FROM k GROUP BY group_hash HAVING count(*) >= 2) SELECT k.* FROM k SEMI JOIN fl USING (group_hash) ANTI JOIN su USING (group_hash)"
)
def visible_occurrences(spark, d):
    rows = store.group_occurrences(_groups(spark, d), _occurrences(spark, d)).select("id", "group_hash", "tier", "path", "start_line", "end_line")
    left = suppress.without_suppressed_occurrences(rows, _occurrence_suppressions(spark, d))
    return suppress.without_suppressed_groups(left, _suppressions(spark, d)).select("id", "group_hash", "tier", "path", "start_line", "end_line")


@query(
    CTE
    + f", x AS (SELECT g.id, g.tier, g.occurrence_count, {HEX.format('g.group_hash')} AS hash, min(o.path) AS first_path, min(o.start_line) AS first_line FROM g LEFT JOIN o ON o.group_id = g.id WHERE g.group_hash NOT IN (SELECT group_hash FROM su) GROUP BY ALL) SELECT id, tier, hash, occurrence_count, row_number() OVER (ORDER BY tier, first_path NULLS FIRST, first_line NULLS FIRST, id) AS ordinal FROM x"
)
def visible_list(spark, d):
    groups = suppress.without_suppressed_groups(_groups(spark, d), _suppressions(spark, d))
    rows = store.list_groups(groups, _occurrences(spark, d))
    return with_ordinal(rows, [F.col("tier"), F.col("first_path"), F.col("first_line"), F.col("id")]).select("id", "tier", "hash", "occurrence_count", "ordinal")


@query(
    CTE
    + ", live AS (SELECT group_hash, min(id) AS live_id FROM g GROUP BY group_hash), la AS (SELECT group_hash, last_group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_hash ORDER BY dismissed_at DESC NULLS LAST, last_group_id DESC NULLS LAST) AS rn FROM suppressions) WHERE rn = 1), oc AS (SELECT group_hash, count(*) AS n, max(dismissed_at) AS at FROM os GROUP BY group_hash) SELECT su.group_hash, su.dismissed_at, coalesce(live_id, last_group_id) AS id, live_id IS NOT NULL AS live, coalesce(oc.n, 0) AS occurrence_dismissals, oc.at AS last_occurrence_dismissal FROM su LEFT JOIN live USING (group_hash) LEFT JOIN la USING (group_hash) LEFT JOIN oc USING (group_hash)"
)
def dismissed_view(spark, d):
    return suppress.dismissed_view(_suppressions(spark, d), _groups(spark, d), _occurrence_suppressions(spark, d))


@query(
    CTE
    + f"SELECT {HEX.format('group_hash')} AS hash, 'Dismissed block (hash ' || substr({HEX.format('group_hash')}, 1, 12) || '…)' AS label, CASE WHEN dismissed_at > 0 THEN strftime(to_timestamp(dismissed_at) AT TIME ZONE 'UTC', '%Y-%m-%d') ELSE 'unknown date' END AS day, row_number() OVER (ORDER BY dismissed_at NULLS FIRST, {HEX.format('group_hash')}) AS ordinal FROM su"
)
def suppressions_list(spark, d):
    rows = _suppressions(spark, d).withColumn("hash", hex16(F.col("group_hash")))
    ranked = with_ordinal(rows, [F.col("dismissed_at"), F.col("hash")])
    return ranked.select("hash", dismissed_label(F.col("group_hash")).alias("label"), unix_date(F.col("dismissed_at")).alias("day"), "ordinal")


@query(
    CTE
    + f""", la AS (SELECT group_hash, dismissed_at, last_group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_hash ORDER BY dismissed_at DESC NULLS LAST, last_group_id DESC NULLS LAST) AS rn FROM suppressions WHERE group_hash IS NOT NULL) WHERE rn = 1)
SELECT group_hash, '{{"hash":"' || {HEX.format("group_hash")} || '"' || coalesce(',"dismissed_at":' || dismissed_at, '') || coalesce(',"last_group_id":' || last_group_id, '') || '}}' AS json FROM la"""
)
def suppressions_json(spark, d):
    return report.suppression_json(_suppressions(spark, d))


# -- history

HEADBASE = ", hb AS (SELECT folder_hash, max(CASE WHEN r = 1 THEN scan_id END) AS head, max(CASE WHEN r = 2 THEN scan_id END) AS base FROM (SELECT *, row_number() OVER (PARTITION BY folder_hash ORDER BY started_at DESC NULLS LAST, scan_id DESC) AS r FROM sc) WHERE r <= 2 GROUP BY folder_hash)"
DIFF = (
    CTE
    + HEADBASE
    + ", b AS (SELECT hb.folder_hash, group_hash, coalesce(occurrence_count, 0) AS base_count FROM sg JOIN hb ON sg.scan_id = hb.base), h AS (SELECT hb.folder_hash, group_hash, coalesce(occurrence_count, 0) AS head_count FROM sg JOIN hb ON sg.scan_id = hb.head WHERE hb.base IS NOT NULL), x AS (SELECT coalesce(b.folder_hash, h.folder_hash) AS folder_hash, coalesce(b.group_hash, h.group_hash) AS group_hash, coalesce(base_count, 0) AS base_count, coalesce(head_count, 0) AS head_count FROM b FULL JOIN h ON b.folder_hash IS NOT DISTINCT FROM h.folder_hash AND b.group_hash = h.group_hash), df AS (SELECT *, CASE WHEN base_count = 0 THEN 'NEW' WHEN head_count = 0 THEN 'GONE' WHEN head_count > base_count THEN 'GREW' ELSE 'SHRANK' END AS kind FROM x WHERE base_count <> head_count)"
)


@query(CTE + HEADBASE + "SELECT folder_hash, head, base FROM hb")
def head_scans(spark, d):
    return history.head_and_base(_scans(spark, d))


@query(
    DIFF
    + f" SELECT folder_hash, group_hash, base_count, head_count, kind, CASE kind WHEN 'GREW' THEN 'GREW ↑' || (head_count - base_count) WHEN 'SHRANK' THEN 'SHRANK ↓' || (base_count - head_count) ELSE kind END AS badge, {HEX.format('group_hash')} AS hash FROM df"
)
def diff_latest(spark, d):
    return history.latest_diff(_scans(spark, d), _scan_groups(spark, d))


@query(
    DIFF
    + f" SELECT folder_hash, rpad(kind, 6, ' ') || '  ' || {HEX.format('group_hash')} || '  ' || base_count || '→' || head_count || '  ' || CASE kind WHEN 'NEW' THEN '+' || head_count WHEN 'GONE' THEN '-' || base_count WHEN 'GREW' THEN '↑' || (head_count - base_count) ELSE '↓' || (base_count - head_count) END AS line FROM df"
)
def diff_text(spark, d):
    return history.diff_text(history.latest_diff(_scans(spark, d), _scan_groups(spark, d)))


@query(CTE + "SELECT group_hash, sg.scan_id, started_at, folder_hash, git_commit, occurrence_count, total_lines FROM sg JOIN sc USING (scan_id)")
def lineage(spark, d):
    return history.lineage(_scans(spark, d), _scan_groups(spark, d))


@query(
    CTE
    + "SELECT group_hash, arg_min(scan_id, (started_at, scan_id)) AS first_scan, min(started_at) AS first_at, arg_max(scan_id, (started_at, scan_id)) AS last_scan, max(started_at) AS last_at, count(*) AS scans FROM sg JOIN sc USING (scan_id) GROUP BY group_hash"
)
def first_seen(spark, d):
    return history.first_seen(_scans(spark, d), _scan_groups(spark, d))


SEVERITY = CTE + ", sv AS (SELECT sc.scan_id, folder_hash, started_at, CAST(coalesce(sum(occurrence_count * total_lines), 0) AS BIGINT) AS severity, count(group_hash) AS groups FROM sc LEFT JOIN sg USING (scan_id) GROUP BY ALL) "


@query(SEVERITY + "SELECT * FROM sv")
def scan_severity(spark, d):
    return history.scan_severity(_scans(spark, d), _scan_groups(spark, d))


@query(
    SEVERITY
    + ", t AS (SELECT *, row_number() OVER (PARTITION BY folder_hash ORDER BY started_at DESC NULLS LAST, scan_id DESC) AS r FROM sv) SELECT folder_hash, scan_id, row_number() OVER (PARTITION BY folder_hash ORDER BY started_at NULLS FIRST, scan_id) AS point, severity, round(severity / greatest(max(severity) OVER (PARTITION BY folder_hash), 1), 6) AS height FROM t WHERE r <= 20"
)
def sparkline_20(spark, d):
    return history.sparkline(history.scan_severity(_scans(spark, d), _scan_groups(spark, d)))


@query(DIFF + " SELECT df.folder_hash, df.group_hash, base_count, coalesce(d.label, CASE WHEN su.group_hash IS NOT NULL THEN 'Dismissed block (hash ' || substr(" + HEX.format("df.group_hash") + ", 1, 12) || '…)' ELSE '' END) AS label FROM df LEFT JOIN (SELECT group_hash, min(label) AS label FROM (" + "SELECT g.group_hash, coalesce(f.path || ':L' || f.start_line || '–' || f.end_line, '(empty group)') AS label FROM g LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY path, start_line, end_line) AS rn FROM o) WHERE rn = 1) f ON f.group_id = g.id) GROUP BY group_hash) d USING (group_hash) LEFT JOIN su ON su.group_hash = df.group_hash WHERE kind = 'GONE'")
def gone_groups(spark, d):
    gone = history.latest_diff(_scans(spark, d), _scan_groups(spark, d)).filter("kind = 'GONE'").select("folder_hash", "group_hash", "base_count")
    labels = _summary(spark, d).groupBy("group_hash").agg(F.min("label").alias("label"))
    dismissed = _suppressions(spark, d).select("group_hash", dismissed_label(F.col("group_hash")).alias("dismissed"))
    return gone.join(labels, "group_hash", "left").join(dismissed, "group_hash", "left").select("folder_hash", "group_hash", "base_count", F.coalesce("label", "dismissed", F.lit("")).alias("label"))


# -- analytics

TIES = HEX.format("group_hash") + ", id"


@query(DETAIL + "SELECT id, n, lines, files, severity, label, language FROM d")
def group_measures(spark, d):
    return _summary(spark, d).select("id", "n", "lines", "files", "severity", "label", "language")


def _sorted(key: str, order: str) -> None:
    def run(spark, d):
        return analytics.sorted_groups(_summary(spark, d), key)

    QUERIES[f"sort_{key}"] = run
    SQL[f"sort_{key}"] = DETAIL + f"SELECT id, row_number() OVER (ORDER BY {order}, {TIES}) AS ordinal FROM d"


_sorted("severity", "severity DESC, lower(coalesce(first_path, ''))")
_sorted("impact", "severity DESC, label")
_sorted("file_count", "files DESC")
_sorted("line_count", "lines DESC")
_sorted("alphabetical", "lower(label)")


@query(DETAIL + "SELECT id, label, language FROM d WHERE contains(lower(label), 'harbor') OR contains(lower(language), 'harbor') OR id IN (SELECT group_id FROM o WHERE contains(lower(path), 'harbor'))")
def search_groups(spark, d):
    return analytics.search(_summary(spark, d), _occurrences(spark, d), " HARBOR ").select("id", "label", "language")


@query(CTE + "SELECT g.id, count(*) AS n, min(path) AS first_path FROM g JOIN o ON o.group_id = g.id WHERE regexp_matches(path, '/SRC/.*[.](ts|py)$', 'i') GROUP BY g.id")
def include_filter(spark, d):
    kept = analytics.include(_occurrences(spark, d), r"/SRC/.*\.(ts|py)$")
    return store.group_summary(_groups(spark, d), kept).filter("n > 0").select("id", "n", F.col("first.path").alias("first_path"))


@query(DETAIL + "SELECT id, tier FROM d WHERE tier = 'A' OR regexp_extract(first_path, '[.]([^./]+)$', 1) IN ('rs', 'py')")
def tier_language_filter(spark, d):
    return analytics.tiers(_summary(spark, d), "both", ("rust", "python")).select("id", "tier")


@query(
    DETAIL
    + ", a AS (SELECT count(*) AS groups, count(*) FILTER (tier = 'B') AS functions, count(*) FILTER (tier <> 'B') AS blocks, (SELECT count(DISTINCT o.path) FROM o JOIN g ON g.id = o.group_id) AS files, CAST(coalesce(sum(CASE WHEN n >= 2 THEN (first_end - first_start + 1) * (n - 1) END), 0) AS BIGINT) AS duplicated_lines FROM d) SELECT *, groups || ' groups · ' || functions || ' functions · ' || blocks || ' blocks · ' || files || ' files · ' || duplicated_lines || ' duplicated lines' AS text FROM a"
)
def summary_counts(spark, d):
    return analytics.summary(_summary(spark, d), _occurrences(spark, d))


@query(CTE + f"SELECT coalesce({LANG.format('path')}, '') AS language, count(*) AS occurrences, count(DISTINCT path) AS files, count(DISTINCT group_id) AS groups FROM o GROUP BY 1")
def language_counts(spark, d):
    return analytics.language_counts(_occurrences(spark, d))


ISSUES = f"WITH i AS (SELECT DISTINCT {CANONICAL_SQL} AS path, kind, message FROM issues WHERE path IS NOT NULL AND kind IS NOT NULL) "


def _issues(spark, d):
    return table(spark, d, "issues").select(canonical_path(F.col("path")).alias("path"), "kind", "message")


@query(ISSUES + "SELECT kind, count(*) AS n, count(DISTINCT path) AS files FROM i GROUP BY kind")
def issue_counts(spark, d):
    return analytics.issue_counts(_issues(spark, d))


@query(
    ISSUES
    + "SELECT DISTINCT path, kind, '- `' || path || '`: ' || CASE kind WHEN 'read_error' THEN 'ReadError' WHEN 'utf8' THEN 'Utf8' WHEN 'tier_b_parse' THEN 'TierBParse' WHEN 'tier_b_panic' THEN 'TierBPanic' ELSE kind END || CASE WHEN coalesce(message, '') = '' THEN '' ELSE ' — ' || message END AS line FROM i"
)
def issue_report(spark, d):
    return analytics.issue_lines(_issues(spark, d))
