"""Directory trees as a corpus of (path, text), with issues for what cannot be read."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.sources.ignore import MAX_FILE_SIZE, has_generated_header, ignored, in_git_dir, looks_binary, rule_regex

#: Bytes of files in one task, and in one batch of it.
TASK_BYTES, BATCH_BYTES = 16 << 20, 8 << 20

_LISTED = "raw binary, path string, length bigint, mtime bigint, error string"


def _rules(names: list[bytes], strip: int, prefix: bytes) -> tuple:
    """Rules of files of one folder, as (strip, prefix, regex, folders only, kept); a path is matched as prefix + path[strip:]."""
    lines = []
    for name in names:
        try:
            with open(name, encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
        except OSError:
            pass
    found = []
    for regex, keep in filter(None, map(rule_regex, lines)):
        core = regex.removesuffix("(?:/.*)?$")
        found.append((strip, prefix, re.compile(core.removesuffix("/.*$") + r"\Z"), core == regex, keep))
    return tuple(found)


def git_rules(root: bytes, folder: bytes) -> tuple:
    """Rules of a folder's .gitignore; at the root those of .git/info/exclude come before them."""
    here = os.path.join(root, folder)
    return _rules(([os.path.join(here, b".git/info/exclude")] if not folder else []) + [os.path.join(here, b".gitignore")], len(folder) + 1 if folder else 0, b"")


def global_excludes() -> str:
    """The user's ignore file: what git is configured to read, else its default place."""
    try:
        said = subprocess.run(["git", "config", "--path", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=10)
        if said.returncode == 0 and said.stdout.strip():
            return said.stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        pass
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config"), "git", "ignore")


def outer_rules(root: bytes) -> tuple:
    """Rules from outside the tree, weakest first: the user's ignore file, then the .gitignore files of the folders above."""
    rules = _rules([os.fsencode(global_excludes())], 0, b"")
    parts = os.path.abspath(root).split(b"/")
    for i in range(1, len(parts)):
        above = b"/".join(parts[:i]) or b"/"
        rules += _rules([os.path.join(above, b".gitignore")], 0, b"/".join(parts[i:]) + b"/")
    return rules


def git_ignored(path: bytes, is_dir: bool, rules: tuple) -> bool:
    """The last rule that matches decides, deeper files after shallower ones. Folders above are not ignored."""
    for strip, prefix, regex, only, keep in reversed(rules):
        if (is_dir or not only) and regex.match(os.fsdecode(prefix + path[strip:])):
            return not keep
    return False


def walk(root: str, gitignore: bool = False, follow: bool = False, submodules: bool = True) -> Iterator[tuple[bytes, int, int, str | None]]:
    """Path below the root, size, time in seconds and error of every file, hidden ones too, but for .git folders.

    Symbolic links are passed over, or followed, but not in circles. Without
    ``submodules`` a folder below the root that holds a .git of its own is
    passed over. What cannot be looked at is a row with an error.
    """
    base = os.fsencode(root)
    todo = [(b"", frozenset(), outer_rules(base) if gitignore else ())]
    while todo:
        folder, above, rules = todo.pop()
        try:
            found = os.stat(os.path.join(base, folder))
            here = (found.st_dev, found.st_ino)
            if here in above:
                continue
            with os.scandir(os.path.join(base, folder)) as entries:
                names = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            if not folder:
                raise
            yield folder, 0, 0, e.strerror
            continue
        if folder and not submodules and any(e.name == b".git" for e in names):
            continue
        if gitignore:
            rules += git_rules(base, folder)
        for entry in names:
            path = os.path.join(folder, entry.name)
            try:
                if not follow and entry.is_symlink() or git_ignored(path, entry.is_dir(), rules):
                    continue
                if entry.is_dir():
                    if entry.name != b".git":
                        todo.append((path, above | {here}, rules))
                elif entry.is_file():
                    found = entry.stat()
                    yield path, found.st_size, int(found.st_mtime), None
            except OSError as e:
                yield path, 0, 0, e.strerror


def list_files(spark: SparkSession, root: str, gitignore: bool = False, follow: bool = False, submodules: bool = True) -> DataFrame:
    """``raw`` and ``path`` relative to root, ``length, mtime, error``. The driver walks, as every file source lists there."""
    rows = list(walk(root, gitignore, follow, submodules))
    raw, length, mtime, error = zip(*rows, strict=True) if rows else ((), (), (), ())
    names = [n.split()[0] for n in _LISTED.split(", ")]
    types = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = (raw, [x.decode("utf-8", "replace") for x in raw], length, mtime, error)
    return spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names), _LISTED).repartition(max(spark.sparkContext.defaultParallelism, sum(length) // TASK_BYTES))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Listed files with ``content``, read where the partition is; an ``error`` instead where that fails."""
    base = os.fsencode(os.path.abspath(root))
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["path", "length", "mtime", "error", "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for raw, path, length, mtime, error in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                content = None
                if error is None:
                    try:
                        with open(os.path.join(base, raw), "rb") as f:
                            content = f.read()
                    except OSError as e:
                        error = e.strerror
                rows.append((path, length, mtime, error, content))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("raw", "path", "length", "mtime", "error").mapInArrow(read, "path string, length bigint, mtime bigint, error string, content binary")


def rules_file(root: str, name: str) -> tuple[str, ...]:
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return tuple(f.read().splitlines())
    except OSError:
        return ()


def candidates(
    spark: SparkSession, root: str, gitignore: bool = True, everything: bool = False, include_submodules: bool = False, limit: int = MAX_FILE_SIZE, project_rules: str = ".twinspanignore", skip: tuple[str, ...] = (), follow: bool = False
) -> DataFrame:
    """Listed files that no rule on names and sizes leaves out; nothing is read yet. Rule files are small and read on the driver."""
    path = F.col("path")
    files = list_files(spark, root, gitignore and not everything, follow, include_submodules).filter(~in_git_dir(path))
    for folder in skip:
        files = files.filter(~path.startswith(folder + "/"))
    files = files.filter(~ignored(path, rules_file(root, project_rules), not everything))
    return files if everything else files.filter(F.col("length") <= limit)


def classified(files: DataFrame, root: str, everything: bool = False) -> DataFrame:
    """``path, length, mtime, status, message, text``: ok with its text, binary, generated, utf8 or read_error."""
    read = with_content(files, root)
    text = F.col("content").cast("string")
    status = F.when(F.col("error").isNotNull(), "read_error")
    if not everything:
        status = status.when(looks_binary(F.col("content")), "binary")
    status = status.when(~F.is_valid_utf8(text), "utf8")
    if not everything:
        status = status.when(has_generated_header(text), "generated")
    told = read.withColumn("status", status.otherwise("ok"))
    message = F.when(F.col("status") == "read_error", F.col("error")).when(F.col("status") == "utf8", "invalid UTF-8")
    return told.select("path", "length", "mtime", "status", message.alias("message"), F.when(F.col("status") == "ok", text).alias("text"))


def status_issues(files: DataFrame) -> DataFrame:
    return files.filter("status IN ('read_error', 'utf8')").select("path", F.col("status").alias("kind"), "message")


def read_corpus(
    spark: SparkSession,
    root: str,
    gitignore: bool = True,
    everything: bool = False,
    include_submodules: bool = False,
    limit: int = MAX_FILE_SIZE,
    project_rules: str = ".twinspanignore",
    skip: tuple[str, ...] = (),
    follow: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The corpus and its issues, without the folders of ``skip``."""
    files = classified(candidates(spark, root, gitignore, everything, include_submodules, limit, project_rules, skip, follow), root, everything)
    return files.filter("status = 'ok'").select("path", "text", "length", "mtime"), status_issues(files)
