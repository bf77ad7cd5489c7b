"""Queries over the texts: ingestion, tokens, windows, matches, details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators import detail, incremental, lexing, matching, units
from twinspan.plans.reference import CTE, _occurrences
from twinspan.session import cut
from twinspan.sources.ignore import BUILT_IN, ingest_status, rule_regex
from twinspan.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file; prose without a path gets one of its id."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select(F.coalesce("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("path"), "text")


CORPUS = "c AS (SELECT coalesce(path, 'doc/' || doc_id) AS path, text FROM documents WHERE text IS NOT NULL)"
_SQL_PATTERN = lexing.PATTERN.replace("'", "''")
TOKENS = f"list_filter(regexp_extract_all(text, '{_SQL_PATTERN}'), lambda x: NOT regexp_matches(x, '{lexing.SKIPPED}'))"


@query(
    f"WITH t AS (SELECT doc_id, {TOKENS.replace('text,', "coalesce(text, ''),")} AS l FROM documents) SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[A-Za-z_\\x{{80}}-\\x{{10FFFF}}]'))) AS INTEGER) AS identifiers, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[0-9]'))) AS INTEGER) AS numbers, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\"'']'))) AS INTEGER) AS strings, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '^[A-Za-z_0-9\"''\\x{{80}}-\\x{{10FFFF}}]'))) AS INTEGER) AS puncts, CAST(len(l) AS INTEGER) AS tokens FROM t"
)
def token_counts(spark, d):
    return lexing.token_counts(table(spark, d, "documents"))


WINDOWS_SQL = f"WITH {CORPUS}, t AS (SELECT path, {TOKENS} AS l FROM c), w AS (SELECT path, i, md5(array_to_string(l[i:i + 49], chr(31))) AS h FROM t, unnest(range(1, len(l) - 48)) AS u(i)), r AS (SELECT h, count(*) AS n FROM w GROUP BY h)"


@query(WINDOWS_SQL + " SELECT path, count(*) AS windows, count(*) FILTER (n > 1) AS repeated FROM w JOIN r USING (h) GROUP BY path")
def repeated_windows(spark, d):
    return lexing.repeats_by_file(lexing.file_windows(_corpus(spark, d)))


@query(
    "WITH t AS (SELECT text, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1) SELECT md5(text) AS digest, copies, first_id FROM t"
)
def exact_copies(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


_BUILT_IN_SQL = " OR ".join(f"regexp_matches(path, '{rule_regex(r)[0]}')" for r in BUILT_IN)


@query(
    f"WITH c AS (SELECT path, text, strlen(text) AS size FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) SELECT path, CASE WHEN list_contains(string_split(path, '/'), '.git') THEN 'git_dir' WHEN {_BUILT_IN_SQL} THEN 'ignored' WHEN size > 1048576 THEN 'too_large' WHEN contains(text[1:512], chr(0)) THEN 'binary' WHEN contains(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '@generated') OR contains(array_to_string(string_split(text, chr(10))[1:5], chr(10)), 'AUTO-GENERATED') THEN 'generated' ELSE 'ok' END AS status FROM c"
)
def ingest_filter(spark, d):
    docs = table(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    return docs.select("path", ingest_status(F.col("path"), F.col("text"), F.octet_length("text")).alias("status"))


@query(
    WINDOWS_SQL
    + f", e AS (SELECT path, unnest(regexp_extract_all(text, '{_SQL_PATTERN}')) AS x, generate_subscripts(regexp_extract_all(text, '{_SQL_PATTERN}'), 1) AS i FROM c), p AS (SELECT path, x, i, sum(strlen(x)) OVER (PARTITION BY path ORDER BY i) AS z FROM e), k AS (SELECT path, z - strlen(x) AS s, z, row_number() OVER (PARTITION BY path ORDER BY i) AS j FROM p WHERE NOT regexp_matches(x, '{lexing.SKIPPED}')), q AS (SELECT w.path, min(i) AS a, max(i) AS b FROM w JOIN r USING (h) WHERE n > 1 GROUP BY w.path) SELECT q.path, CAST(f.s AS INTEGER) AS first_byte, CAST(l.z AS INTEGER) AS last_byte FROM q JOIN k f ON f.path = q.path AND f.j = q.a JOIN k l ON l.path = q.path AND l.j = q.b + 49"
)
def tier_a_reach(spark, d):
    """Where the spans of each file begin and end before any threshold: they cover every repeated window and no other."""
    spans = matching.match_runs(cut(lexing.file_windows(_corpus(spark, d))))
    return spans.groupBy("path").agg(F.min("start_byte").alias("first_byte"), F.max("end_byte").alias("last_byte"))


@query()
def tier_a_groups(spark, d):
    """No SQL: the greedy extension visits windows in order; tested against brute force."""
    return matching.tier_a(_corpus(spark, d))


LATEST = "fp AS (SELECT path, content_hash, size, mtime, block_hashes FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, content_hash DESC NULLS LAST, size DESC NULLS LAST, block_hashes DESC NULLS LAST) AS rn FROM file_blocks WHERE path IS NOT NULL) WHERE rn = 1)"


@query(
    f"WITH {LATEST}, n AS (SELECT path, max(strlen(text)) AS bytes FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path) SELECT coalesce(n.path, fp.path) AS path, CASE WHEN bytes IS NULL THEN 'drop' WHEN fp.path IS NULL THEN 'compute' WHEN bytes = size AND block_hashes IS NOT NULL THEN 'reuse' ELSE 'recompute' END AS action FROM n FULL JOIN fp ON n.path = fp.path"
)
def incremental_plan(spark, d):
    return incremental.plan_run(table(spark, d, "documents"), incremental.latest_fingerprints(table(spark, d, "file_blocks")))


@query(
    f"WITH {LATEST}, x AS (SELECT DISTINCT path, h FROM fp, unnest(block_hashes) AS u(h) WHERE h IS NOT NULL), k AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1) SELECT path, count(*) AS blocks, count(k.h) AS shared FROM x LEFT JOIN k USING (h) GROUP BY path"
)
def shared_blocks(spark, d):
    return incremental.shared_blocks(incremental.latest_fingerprints(table(spark, d, "file_blocks")))


LINES = (
    CTE
    + ", tx AS (SELECT path, string_split(text, chr(10)) AS lines FROM documents WHERE path IS NOT NULL AND text IS NOT NULL), ln AS (SELECT group_id, path, start_line, end_line, i AS line, i - start_line AS rel, lines[i] AS text FROM (SELECT o.*, lines FROM o JOIN tx USING (path)), unnest(range(greatest(start_line - {0}, 1), least(end_line + {0}, len(lines)) + 1)) AS u(i))"
)


@query(LINES.format(3) + " SELECT group_id, path, start_line, end_line, count(*) AS lines, min(line) AS first, max(line) AS last, md5(string_agg(text, chr(10) ORDER BY line)) AS digest FROM ln GROUP BY group_id, path, start_line, end_line")
def context_lines(spark, d):
    lines = detail.occurrence_lines(_occurrences(spark, d), table(spark, d, "documents"), 3)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("group_id", "path", "start_line", "end_line").agg(
        F.count("*").alias("lines"), F.min("line").cast("bigint").alias("first"), F.max("line").cast("bigint").alias("last"), F.md5(body).alias("digest")
    )


@query(
    LINES.format(0)
    + ", mb AS (SELECT group_id, count(DISTINCT (path, start_line, end_line)) AS members FROM ln GROUP BY group_id), pr AS (SELECT group_id, rel, count(*) AS places, min(text) AS lo, max(text) AS hi FROM ln GROUP BY group_id, rel) SELECT group_id, rel, places, lo <> hi OR (places < members AND hi <> '') AS differs FROM pr JOIN mb USING (group_id)"
)
def line_differences(spark, d):
    lines = detail.occurrence_lines(_occurrences(spark, d), table(spark, d, "documents"))
    return detail.line_differences(lines).select("group_id", F.col("rel").cast("bigint").alias("rel"), "places", "differs")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")


@query()
def tier_b_groups(spark, d):
    """No SQL: units come from the languages' grammars; tested against known units."""
    found, _ = units.tier_b(_sources(spark, d))
    return found.select("group_hash", "part", "unit", "path", "start_line", "end_line", "start_byte", "end_byte", "tokens", F.size("alpha").alias("renamed"))


@query()
def unit_issues(spark, d):
    return units.tier_b(_sources(spark, d))[1]


@query()
def promoted_groups(spark, d):
    """Tier A without the spans that tier B covers exactly. No SQL, as for its inputs."""
    corpus = _sources(spark, d)
    return matching.promote(matching.tier_a(corpus), units.tier_b(corpus)[0])
