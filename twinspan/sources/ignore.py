"""Ignore rules in gitignore syntax as column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in rules for minified, generated, lock, text and vendored files.
BUILT_IN = ("*.min.js", "*.min.css", "*.bundle.js", "*.generated.*", "Cargo.lock", "package-lock.json", "yarn.lock", "poetry.lock", "pnpm-lock.yaml", "*.lock", "*.md", "*.txt", "*.log", "vendor/", "third_party/", "third-party/")
MAX_FILE_SIZE = 1 << 20
SNIFF_BYTES = 512
HEADER_LINES = 5
#: What marks a generated file in its first lines, case-sensitive.
GENERATED_MARKS = ("@generated", "AUTO-GENERATED")


def rule_regex(rule: str) -> tuple[str, bool] | None:
    """Regex of the paths that a rule matches, itself or by a parent; whether it re-includes. None for blanks and comments."""
    rule = rule.rstrip("\n").rstrip("\r")
    if not rule.strip() or rule.startswith("#"):
        return None
    rule = re.sub(r"(?<!\\) +$", "", rule)
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule.removeprefix("\\") if rule[:2] in ("\\!", "\\#") else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out += "(?:[^/]+/)*"
            i += 3
        elif rule.startswith("**", i) and i + 2 == len(rule):
            out += ".*"
            i += 2
        elif c == "*":
            out += "[^/]*"
            i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            body = rule[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        else:
            i += 1 + (c == "\\" and i + 1 < len(rule))
            out += re.escape(rule[i - 1])
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", keep


def matches(path: Column, rules: tuple[str, ...] | list[str]) -> Column:
    """1 ignored, -1 re-included, 0 untouched by the last rule that matches."""
    out = F.lit(0)
    for rule in rules:
        found = rule_regex(rule)
        if found:
            out = F.when(path.rlike(found[0]), F.lit(-1 if found[1] else 1)).otherwise(out)
    return out


def ignored(path: Column, project: tuple[str, ...] | list[str] = (), builtin: bool = True) -> Column:
    """Project rules decide; where they are silent, the built-in ones."""
    own = matches(path, project)
    return F.when(own == 1, True).when(own == -1, False).otherwise((matches(path, BUILT_IN) == 1) if builtin else F.lit(False))


def in_git_dir(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), ".git")


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes, of text or binary."""
    return F.locate("\0", F.substring(content.cast("binary"), 1, SNIFF_BYTES).cast("string")) > 0


def has_generated_header(text: Column) -> Column:
    head = F.substring_index(text, "\n", HEADER_LINES)
    return F.coalesce(head.contains(GENERATED_MARKS[0]) | head.contains(GENERATED_MARKS[1]), F.lit(False))


def ingest_status(path: Column, text: Column, size: Column, project: tuple[str, ...] = (), everything: bool = False, limit: int = MAX_FILE_SIZE) -> Column:
    """ok, or why a file is left out: git_dir, ignored, too_large, binary, generated. Cheap tests come first."""
    if everything:
        return F.when(ignored(path, project, False), "ignored").otherwise("ok")
    return (
        F.when(in_git_dir(path), "git_dir")
        .when(ignored(path, project), "ignored")
        .when(size > limit, "too_large")
        .when(looks_binary(text), "binary")
        .when(has_generated_header(text), "generated")
        .otherwise("ok")
    )
