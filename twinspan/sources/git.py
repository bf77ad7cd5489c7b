"""What git says of a tree: commits and who last touched a line. Silence where it cannot say."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass
from datetime import UTC, datetime

#: Seconds after which a question about one line is dropped.
BLAME_SECONDS = 0.5


def _git(folder: str, *words: str, seconds: float = 10.0) -> str | None:
    try:
        said = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, errors="replace", timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return said.stdout if said.returncode == 0 else None


def commit_of(folder: str, name: str = "HEAD") -> str | None:
    """The full hash a name stands for: 40 hex digits or nothing."""
    said = (_git(folder, "rev-parse", name) or "").strip()
    return said if re.fullmatch(r"[0-9A-Fa-f]{40}", said) else None


def main_commit(folder: str) -> str | None:
    return commit_of(folder, "main")


@dataclass(frozen=True)
class Blame:
    author: str
    commit: str
    day: str
    summary: str


def parse_blame(text: str) -> Blame | None:
    """The block that git blame --porcelain writes for one line."""
    head, _, rest = text.lstrip().partition("\n")
    commit = head.split(" ")[0]
    if not re.fullmatch(r"[0-9A-Fa-f]{8,}", commit):
        return None
    fields = dict(re.findall(r"^(author|author-time|summary) (.*)$", rest.partition("\n\t")[0], re.M))
    seconds = fields.get("author-time", "").strip()
    day = datetime.fromtimestamp(int(seconds), UTC).strftime("%Y-%m-%d") if seconds.isdigit() and int(seconds) > 0 else "?"
    return Blame(fields.get("author") or "?", commit[:8], day, fields.get("summary", ""))


_KNOWN: dict[tuple, Blame | None] = {}


def blame(folder: str, path: str, line: int, seconds: float = BLAME_SECONDS) -> Blame | None:
    """Who last touched a line; asked once per path, line and time of the file."""
    try:
        when = os.stat(os.path.join(folder, path)).st_mtime_ns
    except OSError:
        when = None
    key = (folder, path, line, when)
    if key not in _KNOWN:
        said = _git(folder, "blame", "--porcelain", "-L", f"{line},{line}", "--", path, seconds=seconds)
        _KNOWN[key] = parse_blame(said) if said else None
    return _KNOWN[key]
