"""What a source file shows of its origin: marks in path and head, masked tokens, the measures of its form."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that by convention hold third-party code.
VENDOR_DIRS = frozenset("vendor vendored third_party third-party thirdparty external externals extern node_modules bower_components site-packages".split())
#: Directory names that by convention hold built or generated code.
BUILD_DIRS = frozenset("generated gen __generated__ autogenerated build dist target".split())
#: File names of dependency locks.
LOCK_FILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Pipfile.lock composer.lock go.sum".split())
MINIFIED_NAME = r"[.\-](?:min|bundle|chunk|prod|umd)\.[cm]?jsx?$"
GENERATED_NAME = r"(?:\.(?:generated|gen|g|pb|autogen|designer)|_(?:generated|pb2|pb2_grpc|pb))\.[A-Za-z]+$"

#: What generators and importers write at the head of a file: a word for the origin with what it refers to, or an order not to edit.
_GENERATED_HEAD = re.compile(
    r"@generated\b|<auto-generated>|\bAUTO-?GENERATED\b"
    r"|\bDO NOT (?:EDIT|MODIFY|CHANGE)\b|\b(?i:code generated)\b|\b(?i:do not (?:edit|modify|change)(?=\s*(?:[.:!]|this file|by hand|manually|directly)))"
    r"|\b(?i:(?:auto-?|machine[ -])?(?:re)?generated (?:by|from|with|using|file))\b"
    r"|\b(?i:machine (?:generated|written|made)|automatically (?:created|generated|produced|written))\b"
    r"|\b(?i:(?:manual|local|hand) (?:edits|changes) (?:are|will be|get) (?:overwritten|lost|discarded)|(?:regenerate|rebuild|re-?run)\b[^.\n]{0,40} instead|is the source of truth)\b"
)
_VENDOR_HEAD = re.compile(
    r"^/\*!|@license\b|@preserve\b"
    r"|\b(?i:(?:bundled|vendored|unmodified|verbatim) copy of|(?:vendored|copied|imported|taken) (?:from|unchanged|unmodified|verbatim)|upstream, not here)\b"
    r"|\bpart of the [\w.@/-]+ (?:library|package|project)\b|\(c\) the [\w.@/-]+ (?:contributors|authors|developers|team)"
)
_OURS = re.compile(r"\bCopyright the ([\w.-]+) authors\b")

_HASH_COMMENTS = frozenset(("py",))
_LEAD_SLASH = re.compile(r"(?:\s+|#![^\n\[][^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_LEAD_HASH = re.compile(r"(?:\s+|#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))*", re.S)
_SLASH_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*.*?\*/", re.S)
_HASH_COMMENT = re.compile(r"(\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|#[^\n]*", re.S)
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_NUMBER = re.compile(r"(?<![A-Za-z_$])\d[\w.]*")
_NAME = re.compile(r"[^\W\d][\w$]*")
_SPACES = re.compile(r"\s+")
_PACKED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")

#: A file is one statement over and over from this share and this many of its lines.
FAMILY_SHARE, FAMILY_LINES = 0.6, 8
#: A file is a blob from this share of its code characters in bare literals.
BLOB_SHARE = 0.6
#: ... and from so many numbers, or so many characters of packed text.
BLOB_NUMBERS, BLOB_PACKED = 12, 300
#: Length, without strings, of a line no hand writes, and the white space it has at most.
DENSE_LINE, DENSE_SPACE = 120, 0.12


def path_kind(path: Column) -> Column:
    """generated, minified or vendored by the names in a canonical path; else empty."""
    folder = "/(?:{})/"
    return (
        F.when(path.rlike(folder.format("|".join(sorted(VENDOR_DIRS)))), "vendored")
        .when(path.rlike(MINIFIED_NAME), "minified")
        .when(path.rlike(GENERATED_NAME) | F.substring_index(path, "/", -1).isin(*sorted(LOCK_FILES)) | path.rlike(folder.format("|".join(sorted(BUILD_DIRS)))), "generated")
        .otherwise("")
    )


def head_kind(text: str, extension: str) -> str:
    """What the comments before the first code say of the file's origin."""
    lead = (_LEAD_HASH if extension in _HASH_COMMENTS else _LEAD_SLASH).match(text).group()
    if not lead.strip():
        return ""
    if _GENERATED_HEAD.search(lead):
        return "generated"
    if _VENDOR_HEAD.search(lead):
        return "vendored"
    return "ours" if _OURS.search(lead) else ""


def code_of(text: str, extension: str) -> str:
    """The text without comments."""
    if extension == "json":
        return text
    return (_HASH_COMMENT if extension in _HASH_COMMENTS else _SLASH_COMMENT).sub(lambda m: m.group(1) or " ", text)


def tokens_of(code: str) -> list[str]:
    return _TOKEN.findall(code)


def is_evidence(token: str) -> bool:
    """A literal that tells files apart: no single digit and no string of one character."""
    return len(token) > 1 and token[0].isdigit() or len(token) > 3 and token[0] in "\"'"


def is_packed(token: str) -> bool:
    return token[0] in "\"'" and _PACKED.fullmatch(token[1:-1]) is not None


def dense_share(code: str) -> float:
    """Share of the code in lines that are longer and closer than any hand writes."""
    lines = code.split("\n")
    if max(map(len, lines)) < DENSE_LINE:
        return 0.0
    lines = [x for x in _STRING.sub('""', code).split("\n") if x.strip()]
    dense = [x for x in lines if len(x) >= DENSE_LINE and len(_SPACES.findall(x)) <= DENSE_SPACE * len(x) and len(_NAME.findall(x)) * 25 > len(x)]
    return sum(map(len, dense)) / max(1, sum(map(len, lines)))


def form_kind(code: str, extension: str) -> str:
    """blob or generated by the form of one file, for files that stand alone; else empty."""
    bare = _STRING.sub('""', code)
    lines = [x for x in bare.split("\n") if x.strip()]
    if not lines:
        return ""
    total = sum(map(len, lines))
    masked = [_NUMBER.sub("0", x) for x in lines]
    numbers = sum(len(_NUMBER.findall(x)) for x in lines)
    if extension == "json":  # keys are no names here, so only numbers count
        literal = sum(len(x) for x, y in zip(lines, masked, strict=True) if "0" in y and '"' not in y)
    else:
        literal = sum(len(x) for x, y in zip(lines, masked, strict=True) if not _NAME.search(y) and ("0" in y or '"' in y))
    packed = sum(len(m) for m in _PACKED.findall(code))
    if literal > BLOB_SHARE * total and numbers >= BLOB_NUMBERS or packed > BLOB_SHARE * len(_SPACES.sub(" ", code)) and packed >= BLOB_PACKED:
        return "blob"
    top = Counter(_NAME.sub("i", y).strip() for y in masked if not y[0].isspace() and "0" in y and extension != "json").most_common(1)
    return "generated" if top and top[0][1] >= max(FAMILY_LINES, FAMILY_SHARE * len(lines)) else ""
