"""The language-oblivious lexer and its windows of tokens.

Tokens are identifiers, numbers, strings and single punctuation characters;
white space, line comments (// and #) and block comments separate them. One
regular expression covers every byte, so positions are sums of lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.session import cut, spread

WINDOW = 50
_U = np.uint64
#: Seed and multiplier of the token and window hashes.
SEED, MUL = 0xCBF29CE484222325, 0x100000001B3

_QUOTED = r'{0}[^{0}\\]*(?:\\(?s:.)[^{0}\\]*)*(?:{0}|\\?{1})'
_SKIPPED = r"[ \t\n\r\f]+|//[^\n]*|#[^\n]*|/\*(?s:.*?)(?:\*/|{1})"
_NUMBER = r"[0-9][A-DF-Za-df-z0-9_.]*(?:[eE]+[+-]?[A-DF-Za-df-z0-9_.]*)*"


def lexeme_pattern(high: str, end: str = r"\z") -> str:
    """The pattern of all lexemes; ``high`` is the class of non-ASCII characters."""
    parts = [_SKIPPED.replace("{1}", end), *[_QUOTED.replace("{0}", q).replace("{1}", end) for q in "\"'"], _NUMBER, rf"[A-Za-z_{high}][A-Za-z0-9_{high}]*", r"(?s:.)"]
    return "|".join(parts)


#: For engines whose expressions know code points, such as DuckDB.
PATTERN = lexeme_pattern(r"\x{80}-\x{10FFFF}")
SKIPPED = r"^(?:[ \t\n\r\f]|//|#|/\*)"
_BYTES = re.compile(lexeme_pattern(r"\x80-\xff", r"\Z").encode("latin-1"))
_KINDS = np.full(256, 4, np.uint8)
for _c in range(256):
    if chr(_c) in "\"'":
        _KINDS[_c] = 3
    elif chr(_c).isdigit() and _c < 128:
        _KINDS[_c] = 2
    elif _c >= 128 or chr(_c).isalpha() or _c == 95:
        _KINDS[_c] = 1
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f#", np.uint8))


def _scan(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All lexemes, their starts and ends, and which of them are tokens."""
    all_ = _BYTES.findall(data)
    length = np.fromiter(map(len, all_), np.int64, len(all_))
    ends = np.cumsum(length)
    starts = ends - length
    raw = np.frombuffer(data, np.uint8)
    first = raw[starts]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    skip = _BLANK[first] | (first == 47) & (length > 1) & ((second == 47) | (second == 42))
    return all_, starts, ends, np.flatnonzero(~skip)


def lex(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of UTF-8 bytes, their starts, ends and 1-based lines."""
    if not data:
        return [], *(np.empty(0, np.int64),) * 3
    all_, starts, ends, keep = _scan(data)
    breaks = np.cumsum(np.frombuffer(data, np.uint8) == 10)
    starts = starts[keep]
    return [all_[i] for i in keep.tolist()], starts, ends[keep], np.where(starts > 0, breaks[starts - 1], 0) + 1


def kind_counts(data: bytes) -> np.ndarray:
    """Identifiers, numbers, strings and single characters among the tokens."""
    if not data:
        return np.zeros(4, np.int64)
    _, starts, _, keep = _scan(data)
    return np.bincount(_KINDS[np.frombuffer(data, np.uint8)[starts[keep]]], minlength=5)[1:]


_TOKEN_HASHES: dict[bytes, int] = {}
_MASK = (1 << 64) - 1


def token_hash(token: bytes) -> int:
    h = SEED ^ int(_KINDS[token[0]])
    for b in token:
        h = (h ^ b) * MUL & _MASK
    return h


def window_hashes(tokens: list[bytes], n: int = WINDOW) -> np.ndarray:
    """Polynomial hash of every run of n tokens."""
    if n <= 0 or len(tokens) < n:
        return np.empty(0, _U)
    if len(_TOKEN_HASHES) > 400_000:
        _TOKEN_HASHES.clear()
    known = _TOKEN_HASHES
    for t in set(tokens).difference(known):
        known[t] = token_hash(t)
    h = np.fromiter(map(known.__getitem__, tokens), _U, len(tokens))
    power, inverse = _powers(len(tokens))
    prefix = np.zeros(len(h) + 1, _U)
    np.cumsum(h * inverse[: len(h)], out=prefix[1:])
    count = len(h) - n + 1
    return (prefix[n:] - prefix[:count]) * power[n - 1 : n - 1 + count]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * n, 1 << 14)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, m, _U)])) for m in (MUL, pow(MUL, -1, 1 << 64))]
    return _POWERS


def token_counts(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, identifiers, numbers, strings, puncts, tokens`` of each text.

    A null text counts as empty. No shuffle but for scans of few splits. The
    JVM's regular expressions would do for most texts, at half the speed, but
    their matcher exhausts the stack on long literals with many escapes.
    """
    source = spread(corpus.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([kind_counts((x or "").encode()) for x in batch.column(1).to_pylist()], np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(4)], pa.array(rows.sum(1, dtype=np.int32))], names=["k", "identifiers", "numbers", "strings", "puncts", "tokens"])

    return source.mapInArrow(run, f"k {kind}, identifiers int, numbers int, strings int, puncts int, tokens int").withColumnRenamed("k", key)


_WINDOWS = "path string, win int, h bigint, start_line int, end_line int, start_byte int, end_byte int"


def windows(corpus: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per window of n tokens of each (path, text). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                tokens, starts, ends, lines = lex(data)
                h = window_hashes(tokens, n)
                if len(h):
                    c = len(h)
                    columns = [np.arange(c), None, lines[:c], lines[n - 1 :], starts[:c], ends[n - 1 :]]
                    arrays = [pa.array(h.view(np.int64)) if x is None else pa.array(x.astype(np.int32)) for x in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * c, pa.string()), *arrays], names=[f.split()[0] for f in _WINDOWS.split(", ")])

    return spread(corpus.select("path", "text")).mapInArrow(run, _WINDOWS)


FILES = "path string, hs array<bigint>, start_line array<int>, end_line array<int>, start_byte array<int>, end_byte array<int>"
#: Repeated hashes are broadcast up to so many, 8 bytes each.
BROADCAST_HASHES = 1_000_000


def file_windows(corpus: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per (path, text): the hashes of its windows and where each begins and ends, as arrays. No shuffle.

    All that follows works on these rows, so that each text is lexed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                tokens, starts, ends, lines = lex((text.as_py() or "").encode())
                h = window_hashes(tokens, n)
                c = len(h)
                rows.append((h.view(np.int64), *(x.astype(np.int32) for x in (lines[:c], lines[n - 1 :][:c], starts[:c], ends[n - 1 :][:c]))))
            types = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[f.split()[0] for f in FILES.split(", ")])

    return spread(corpus.select("path", "text")).mapInArrow(run, FILES)


def file_id(path: str = "path") -> Column:
    """What stands for a path while its windows are shuffled."""
    return F.xxhash64(path).alias("fid")


def repeated_hashes(files: DataFrame) -> DataFrame:
    """``h`` of every window that occurs more than once: nothing but hashes is shuffled, after partial counts."""
    return files.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def repeated_cells(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """``fid, win, h, start_line, end_line, start_byte, end_byte`` of the windows with one of the hashes.

    A few hashes go to the files; only more than ``BROADCAST_HASHES`` need a shuffle of the windows.
    """
    parts = ["hs", "start_line", "end_line", "start_byte", "end_byte"]
    cells = files.select(file_id(), F.posexplode(F.arrays_zip(*parts)).alias("win", "c")).select("fid", "win", F.col("c.hs").alias("h"), *[f"c.{x}" for x in parts[1:]])
    few = hashes.count() <= BROADCAST_HASHES
    return cells.join(F.broadcast(hashes) if few else hashes, "h", "left_semi")


def repeats_by_file(files: DataFrame) -> DataFrame:
    """``path, windows, repeated``: how many windows of each file there are, and how many occur elsewhere or again."""
    files = cut(files)
    hashes = cut(repeated_hashes(files))
    few = hashes.count() <= BROADCAST_HASHES
    cells = files.select(file_id(), F.explode("hs").alias("h"))
    found = cells.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").groupBy("fid").agg(F.count("*").alias("repeated"))
    sizes = files.select("path", file_id(), F.size("hs").cast("bigint").alias("windows")).filter("windows > 0").groupBy("path", "fid").agg(F.sum("windows").alias("windows"))
    return sizes.join(found, "fid", "left").select("path", "windows", F.coalesce("repeated", F.lit(0)).alias("repeated"))
