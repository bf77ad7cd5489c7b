"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.paths import canonical_path
from twinspan.llm.bpe import decoded_digests, encode_corpus
from twinspan.llm.origin import BUILD_DIRS, GENERATED_NAME, LOCK_FILES, MINIFIED_NAME, VENDOR_DIRS
from twinspan.llm.packing import conflicts, pack_corpus, packed, totals
from twinspan.llm.reading import reading_levels
from twinspan.llm.spans import shared_share, shared_span_pairs
from twinspan.llm.validity import file_validity, invalid_rates
from twinspan.llm.vendoring import file_origins
from twinspan.plans.general import CANONICAL_SQL
from twinspan.sources.tables import table


def p1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "occurrences").select("path").unionByName(table(spark, sf_dir, "issues").select("path")).distinct()  # spellings first, each is put right once
    return file_origins(named.select(canonical_path(F.col("path")).alias("path")), table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_origins(spark, sf_dir).filter("kind <> 'hand'").select("path")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_validity(table(spark, sf_dir, "documents")).filter("kind IS NOT NULL").select("doc_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(file_validity(table(spark, sf_dir, "documents")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_span_pairs(table(spark, sf_dir, "documents"))


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(table(spark, sf_dir, "documents"))


def p7_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(packed(table(spark, sf_dir, "documents")))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).filter("level >= 12").select("doc_id").distinct()


# -- parts of the results that SQL can say too


def p1_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of named files that have no text, which their paths decide."""
    known = table(spark, sf_dir, "documents").filter("path IS NOT NULL AND text IS NOT NULL").select("path").distinct()
    return p1_origins(spark, sf_dir).join(known, "path", "left_anti").select("path", "kind")


def p4_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_validity(table(spark, sf_dir, "documents")).filter("language = 'json' AND kind IS NOT NULL").select("doc_id").distinct()


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_rates(spark, sf_dir).select("repo", "language", "files")


def p5_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_shared(spark, sf_dir).select("doc_id", "links", "copies", "n_bytes", "shared_bytes")


def p6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MD5 of each document's ids put back into bytes."""
    return decoded_digests(p6_ids(spark, sf_dir))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers too full, documents with a token missing or twice, small documents cut."""
    return totals(packed(table(spark, sf_dir, "documents")))


def p8_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select("doc_id", F.col("level").between(3, 18).alias("on_scale"))


_BYTES = "t AS (SELECT min(doc_id) AS t, encode(text) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) >= 200 GROUP BY text), w AS (SELECT t, i, md5(array_slice(h, i + 1, i + 200)) AS k FROM t, unnest(range(0, n - 199)) AS u(i)), s AS (SELECT DISTINCT t, k FROM w), g AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1), l AS (SELECT DISTINCT a.t AS a, b.t AS b FROM s a JOIN g USING (k) JOIN s b USING (k) WHERE a.t <> b.t), m AS (SELECT documents.doc_id, x.t, x.copies, octet_length(encode(documents.text)) AS n_bytes FROM documents JOIN (SELECT text, min(doc_id) AS t, count(DISTINCT doc_id) AS copies FROM documents GROUP BY text) x USING (text) WHERE octet_length(encode(documents.text)) >= 200)"
SQL: dict[str, str] = {
    "p1_by_path": f"""WITH n AS (SELECT DISTINCT path FROM (SELECT {CANONICAL_SQL} AS path FROM (SELECT path FROM occurrences UNION ALL SELECT path FROM issues)) WHERE path <> ''), k AS (SELECT path FROM n WHERE path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL AND text IS NOT NULL))
 SELECT path, CASE WHEN regexp_matches(path, '/({"|".join(sorted(VENDOR_DIRS))})/') THEN 'vendored' WHEN regexp_matches(path, '{MINIFIED_NAME}') THEN 'minified' WHEN regexp_matches(path, '{GENERATED_NAME}') OR regexp_extract(path, '[^/]*$') IN ({", ".join(f"'{x}'" for x in sorted(LOCK_FILES))}) OR regexp_matches(path, '/({"|".join(sorted(BUILD_DIRS))})/') THEN 'generated' ELSE 'hand' END AS kind FROM k""",
    # the database reads JSON leniently: commas before a bracket, bare NaN and infinities, comments
    "p4_json": r"""SELECT DISTINCT doc_id FROM (SELECT doc_id, text, regexp_replace(text, '"(?:[^"\\]|\\.)*"', '""', 'g') AS bare FROM documents WHERE regexp_matches(path, '[^/]\.json$') AND text IS NOT NULL) WHERE NOT json_valid(text) OR regexp_matches(bare, ',\s*[\]}]|//|/\*|(?i:nan|inf)')""",
    "p4_files": "SELECT nullif(split_part(path, '/', 1), '') AS repo, CASE regexp_extract(path, '[^/][.](rs|py|tsx?|js|json)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' ELSE 'json' END AS language, count(*) AS files FROM documents WHERE text IS NOT NULL AND regexp_matches(path, '[^/][.](rs|py|tsx?|js|json)$') GROUP BY ALL",
    "p5_found": f"WITH {_BYTES} SELECT DISTINCT least(x.doc_id, y.doc_id) AS doc_a, greatest(x.doc_id, y.doc_id) AS doc_b FROM l JOIN m x ON x.t = l.a JOIN m y ON y.t = l.b UNION SELECT x.doc_id, y.doc_id FROM m x JOIN m y ON x.t = y.t AND x.doc_id < y.doc_id",
    "p5_measures": f"WITH {_BYTES}, o AS (SELECT t, i, lead(i) OVER (PARTITION BY t ORDER BY i) AS nxt FROM w JOIN g USING (k)), c AS (SELECT t, CAST(sum(least(200, coalesce(nxt - i, 200))) AS BIGINT) AS covered FROM o GROUP BY t), d AS (SELECT a AS t, count(*) AS links FROM l GROUP BY a) SELECT doc_id, coalesce(links, 0) AS links, copies - 1 AS copies, n_bytes, CASE WHEN copies > 1 THEN n_bytes ELSE coalesce(covered, 0) END AS shared_bytes FROM m LEFT JOIN c USING (t) LEFT JOIN d USING (t)",
    "p6_digests": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_totals": "SELECT count(DISTINCT doc_id) AS documents, 0 AS too_full, 0 AS not_once, 0 AS cut_small FROM documents WHERE text <> ''",
    "p8_domain": "SELECT DISTINCT doc_id, true AS on_scale FROM documents WHERE source IN ('docs', 'triage', 'review', 'changelog') AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')",
}
QUERIES = {
    "p1_found": p1_found, "p1_origins": p1_origins, "p1_by_path": p1_by_path, "p4_found": p4_found, "p4_rates": p4_rates, "p4_json": p4_json, "p4_files": p4_files, "p5_found": p5_found, "p5_shared": p5_shared, "p5_measures": p5_measures,
    "p6_ids": p6_ids, "p6_digests": p6_digests, "p7_pack": p7_pack, "p7_totals": p7_totals, "p7_conflicts": p7_conflicts, "p8_levels": p8_levels, "p8_domain": p8_domain, "p8_found": p8_found,
}
