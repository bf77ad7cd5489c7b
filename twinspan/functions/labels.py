"""Scalar functions of the reports, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language label by lower-case extension.
LANGUAGE_LABELS = {
    "rs": "Rust", "py": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JSX",
    "ts": "TypeScript", "tsx": "TSX", "go": "Go", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "c": "C", "h": "C",
    "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "cs": "C#", "rb": "Ruby", "swift": "Swift",
    "php": "PHP", "scala": "Scala", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
}

#: Display labels of issue kinds.
ISSUE_LABELS = {"read_error": "ReadError", "utf8": "Utf8", "tier_b_parse": "TierBParse", "tier_b_panic": "TierBPanic"}


def hex16(value: Column) -> Column:
    """A 64-bit pattern as 16 lower-case hex digits; sorts as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def unhex16(text: Column) -> Column:
    """The signed 64-bit pattern of up to 16 hex digits."""
    return F.conv(text, 16, -10).cast("bigint")


def language_of(path: Column) -> Column:
    """Label by extension; null where unknown. Dot files have no extension."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_LABELS.items() for x in kv])
    return F.try_element_at(table, ext)


def occurrence_label(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":L"), start.cast("string"), F.lit("–"), end.cast("string"))


def dismissed_label(hash_: Column) -> Column:
    return F.concat(F.lit("Dismissed block (hash "), F.substring(hex16(hash_), 1, 12), F.lit("…)"))


def unix_date(seconds: Column) -> Column:
    """UTC date; ``unknown date`` for null and non-positive seconds."""
    return F.when(seconds > 0, F.date_format(F.to_timestamp_ntz(F.timestamp_seconds(seconds).cast("string")), "yyyy-MM-dd")).otherwise("unknown date")


def classify(base: Column, head: Column) -> Column:
    """Badge of a pair of counts, zero standing for absence."""
    return F.when((base == 0) & (head > 0), "NEW").when((base > 0) & (head == 0), "GONE").when(head > base, "GREW").when(head < base, "SHRANK").otherwise("UNCHANGED")


def badge(base: Column, head: Column) -> Column:
    kind = classify(base, head)
    return (
        F.when(kind == "GREW", F.concat(F.lit("GREW ↑"), (head - base).cast("string")))
        .when(kind == "SHRANK", F.concat(F.lit("SHRANK ↓"), (base - head).cast("string")))
        .when(kind == "UNCHANGED", "")
        .otherwise(kind)
    )


def tint(idx: Column, colours: int = 10) -> Column:
    """Palette slot of a 1-based placeholder."""
    return F.pmod(idx - 1, F.lit(colours))


def blob_hash(blob: Column) -> Column:
    """The signed 64-bit pattern of eight big-endian bytes; null for any other length."""
    return F.when(F.octet_length(blob) == 8, unhex16(F.hex(blob)))


def tier_label(tier: Column) -> Column:
    """A or B; what is neither counts as A."""
    return F.when(F.upper(tier) == "B", "B").otherwise("A")


def elapsed(seconds: Column) -> Column:
    """One decimal under a minute, whole seconds from there."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.concat(F.floor(seconds).cast("string"), F.lit("s")))


def completion_banner(groups: Column, files: Column, seconds: Column) -> Column:
    return F.concat(F.lit("Scan complete — "), groups.cast("string"), F.lit(" groups across "), files.cast("string"), F.lit(" files in "), elapsed(seconds), F.lit("."))


def group_label(tier: Column, name: Column, kind: Column, place: Column) -> Column:
    """A unit's kind and name for tier B where it has one, else the place."""
    named = F.when(kind.isNull(), name).otherwise(F.concat(kind, F.lit(" "), name))
    return F.when((tier == "B") & name.isNotNull(), named).otherwise(F.coalesce(place, F.lit("(empty group)")))
