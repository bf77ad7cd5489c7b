"""Views over groups: sorting, searching, summaries, language counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.labels import ISSUE_LABELS, hex16, language_of
from twinspan.operators.ranking import with_ordinal

SORT_KEYS = ("severity", "impact", "file_count", "line_count", "alphabetical", "recently_dismissed")


def order_of(key: str) -> list[Column]:
    """Sort columns of a sort key over a group summary; the hash (unsigned) and id break ties."""
    ties = [F.coalesce(hex16(F.col("group_hash")), F.lit("0" * 16)), F.col("id")]
    first = F.lower(F.coalesce(F.col("first.path"), F.lit("")))
    return {
        "severity": [-F.col("severity"), first, *ties],
        "impact": [-F.col("severity"), F.col("label"), *ties],
        "file_count": [-F.col("files"), *ties],
        "line_count": [-F.col("lines"), *ties],
        "alphabetical": [F.lower("label"), *ties],
        "recently_dismissed": [F.lower("label"), *ties],
    }[key]


def sorted_groups(summary: DataFrame, key: str) -> DataFrame:
    """``id, ordinal``: the position of each group under a sort key. Only the keys are sorted."""
    order = order_of(key)
    names = [f"k{i}" for i in range(len(order))]
    return with_ordinal(summary.select("id", *[c.alias(n) for c, n in zip(order, names, strict=True)]), [F.col(n) for n in names]).select("id", "ordinal")


def search(summary: DataFrame, occurrences: DataFrame, query: str) -> DataFrame:
    """Groups with a case-insensitive substring in their label, their language or any path."""
    needle = query.strip().lower()
    if not needle:
        return summary
    paths = occurrences.filter(F.lower("path").contains(needle)).select(F.col("group_id").alias("id")).distinct()
    hit = F.lower("label").contains(needle) | F.coalesce(F.lower("language").contains(needle), F.lit(False)) | F.coalesce("by_path", F.lit(False))
    return summary.join(paths.withColumn("by_path", F.lit(True)), "id", "left").filter(hit).drop("by_path")


def include(occurrences: DataFrame, pattern: str) -> DataFrame:
    """Only occurrences whose path matches, case-insensitively.

    A pattern that is no regular expression leaves everything as it was.
    """
    try:
        re.compile(pattern)
    except re.error:
        return occurrences
    return occurrences.filter(F.col("path").rlike(f"(?i){pattern}")) if pattern else occurrences


def tiers(df: DataFrame, tier: str = "both", languages: tuple[str, ...] = (), first: Column | None = None) -> DataFrame:
    """Tier a, b or both; languages (rust, ts, python) narrow tier B by the extension of the first path."""
    kept = df if tier == "both" else df.filter(F.col("tier") == tier.upper())
    if not languages:
        return kept
    exts = [e for lang in languages for e in {"rust": ("rs",), "ts": ("ts", "tsx"), "python": ("py",)}[lang]]
    return kept.filter((F.col("tier") == "A") | F.regexp_extract(F.col("first.path") if first is None else first, r"\.([^./]+)$", 1).isin(*exts))


def summary(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row from a group summary and its occurrences: groups, functions (B), blocks (A), files, removable lines."""
    span = F.greatest(F.col("first.end_line") - F.col("first.start_line") + 1, F.lit(0))
    one = groups.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("tier") == "B").alias("functions"),
        F.count_if(F.col("tier") != "B").alias("blocks"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, span * (F.col("n") - 1))), F.lit(0)).cast("bigint").alias("duplicated_lines"),
    )
    ids = groups.select(F.col("id").alias("group_id"))
    files = occurrences.join(ids, "group_id", "left_semi").agg(F.count_distinct("path").alias("files"))
    both = one.join(files)  # one row each
    text = F.concat_ws(" · ", *[F.concat(F.col(c).cast("string"), F.lit(" " + c.replace("_", " "))) for c in ("groups", "functions", "blocks", "files", "duplicated_lines")])
    return both.select("groups", "functions", "blocks", "files", "duplicated_lines", text.alias("text"))


def language_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy(F.coalesce(language_of(F.col("path")), F.lit("")).alias("language")).agg(F.count("*").alias("occurrences"), F.count_distinct("path").alias("files"), F.count_distinct("group_id").alias("groups"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.filter("path IS NOT NULL AND kind IS NOT NULL").select("path", "kind", "message").distinct().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def issue_lines(issues: DataFrame) -> DataFrame:
    """Markdown line of each distinct issue."""
    table = F.create_map(*[F.lit(x) for kv in ISSUE_LABELS.items() for x in kv])
    head = F.concat(F.lit("- `"), "path", F.lit("`: "), F.coalesce(F.try_element_at(table, F.col("kind")), F.col("kind")))
    tail = F.when(F.coalesce("message", F.lit("")) == "", "").otherwise(F.concat(F.lit(" — "), "message"))
    return issues.filter("path IS NOT NULL AND kind IS NOT NULL").select("path", "kind", F.concat(head, tail).alias("line")).distinct()
