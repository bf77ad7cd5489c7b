"""Path functions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_ROOT = "/srv/checkout"


def canonical_path(path: Column, root: str = SCAN_ROOT) -> Column:
    """Spell a path relative to the scan root.

    Back slashes become forward ones, empty and ``.`` components vanish and
    the root is taken off where the path is absolute. Null stays null; a path
    without components gives the empty string.
    """
    slashed = F.translate(path, "\\", "/")
    body = F.regexp_replace(F.concat(F.lit("/"), slashed), r"(?:/\.?)+(?=/|$)", "")
    prefix = "/" + "/".join(x for x in root.split("/") if x not in ("", ".")) + "/"
    rooted = slashed.startswith("/") & F.concat(body, F.lit("/")).startswith(prefix)
    return F.when(rooted, F.substring(body, len(prefix) + 1, 1 << 30)).otherwise(F.substring(body, 2, 1 << 30))


def posix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")

