"""What the recognisers share."""

from __future__ import annotations

import re

_MARKER = re.compile(r"^(<{7}|>{7}|\|{7})( |$)|^={7}$", re.M)


class Bad(Exception):
    """The text is not valid from this offset on."""

    def __init__(self, kind: str, at: int):
        super().__init__(kind)
        self.kind, self.at = kind, at


def explain(text: str, error: Bad) -> str:
    """The kind of an error; a conflict marker on its line is told first."""
    start = text.rfind("\n", 0, error.at) + 1
    end = text.find("\n", error.at)
    line = text[start : end if end >= 0 else len(text)].rstrip("\r")
    return "merge_conflict_marker" if _MARKER.match(line) else error.kind
