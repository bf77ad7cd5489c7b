"""Byte-level BPE with public rank files, over whole corpora.

A text is cut into pre-tokens by the tokenizer's pattern; each distinct
pre-token is merged once per worker by a rank queue and then looked up. The
queue keeps one bucket of linked-list positions per merge rank, finds the next
rank with a two-level bitmap by find-first-set, and skips stale entries, so a
very long pre-token costs about as many steps as it has bytes.
"""

from __future__ import annotations

import base64
import os
from hashlib import md5
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinspan.session import spread

#: Default place of the vocabulary files; a parameter everywhere.
TOKENIZER_DIR = os.environ.get("TWINSPAN_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: The published splitting pattern of the byte-level tokenizers,
#: with white space spelt out as Unicode's White_Space property.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII_SPACE = r"\t-\r "
_ASCII = rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_SPACE}A-Za-z0-9]+|[{_ASCII_SPACE}]+(?![^{_ASCII_SPACE}])|[{_ASCII_SPACE}]+"

#: Pre-tokens a worker remembers before it starts afresh (memory, not results).
CACHE_ENTRIES = 300_000
CACHE_CHARS = 20_000_000
#: Longer texts are worked off in segments of about so many characters.
SEGMENT_CHARS = 1_000_000
_BORDER = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def byte_pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each two-byte sequence, -1 where there is none."""
    out = np.full(1 << 16, -1, np.int32)
    for raw, rank in ranks.items():
        if len(raw) == 2:
            out[raw[0] << 8 | raw[1]] = rank
    return out


def rank_queue_merge(pieces: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray) -> list[tuple[int, ...]]:
    """Merge the bytes of pre-tokens, in each lowest rank first, leftmost first.

    One queue serves the whole list: positions of all pieces lie in one linked
    list with walls between pieces, and each bucket is worked off from left to
    right. Pieces do not touch each other, so their order does not matter.
    """
    text = b"".join(pieces)
    n = len(text)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    wall = np.zeros(n + 1, bool)
    wall[ends] = True
    wall[0] = True
    nxt = list(range(1, n + 1))
    prev = list(range(-1, n))
    stop = wall.tolist()
    raw = np.frombuffer(text, np.uint8).astype(np.int32)
    found = pairs[raw[:-1] << 8 | raw[1:]] if n > 1 else np.empty(0, np.int32)
    at = np.flatnonzero((found >= 0) & ~wall[1:n])
    order = at[np.argsort(found[at], kind="stable")]
    values, first = np.unique(found[order], return_index=True)
    buckets = {r: [(i, i + 2) for i in part] for r, part in zip(values.tolist(), map(np.ndarray.tolist, np.split(order, first[1:])), strict=False)}
    low: dict[int, int] = {}
    top = 0
    for r in buckets:
        low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
        top |= 1 << (r >> 8)
    get = ranks.get
    while top:
        hi = (top & -top).bit_length() - 1
        word = low[hi]
        rank = hi << 8 | (word & -word).bit_length() - 1
        word &= word - 1
        low[hi] = word
        if not word:
            top &= top - 1
        entries = buckets.pop(rank)
        entries.sort()
        lowest = rank + 1
        for done, (i, end) in enumerate(entries):
            mid = nxt[i]
            if mid < 0 or mid >= end or nxt[mid] != end:
                continue  # stale
            nxt[i] = end
            nxt[mid] = -1
            if not stop[i]:
                a = prev[i]
                r = get(text[a:end])
                if r is not None:
                    if r in buckets:
                        buckets[r].append((a, end))
                    else:
                        buckets[r] = [(a, end)]
                        low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    if r < lowest:
                        lowest = r
            if not stop[end]:
                prev[end] = i
                b = nxt[end]
                r = get(text[i:b])
                if r is not None:
                    if r in buckets:
                        buckets[r].append((i, b))
                    else:
                        buckets[r] = [(i, b)]
                        low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    if r < lowest:
                        lowest = r
            if lowest <= rank:  # a new pair comes before the rest of this bucket
                rest = entries[done + 1 :]
                if rest:
                    if rank in buckets:
                        buckets[rank] += rest
                    else:
                        buckets[rank] = rest
                        low[hi] = low.get(hi, 0) | 1 << (rank & 255)
                        top |= 1 << hi
                break
    out, i = [], 0
    for end in ends.tolist():
        ids = []
        while i < end:
            j = nxt[i]
            ids.append(ranks[text[i:j]])
            i = j
        out.append(tuple(ids))
    return out


class Encoder:
    """Looks pre-tokens up; those not seen yet are merged together and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = byte_pair_table(ranks)
        self.known: dict[str, tuple[int, ...]] = {}
        self.chars = 0
        self._ascii = re.compile(_ASCII).findall
        self._any = regex.compile(_PATTERN).findall

    def split(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of each text, all of them known afterwards."""
        if len(self.known) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        parts = [self._ascii(t) if t.isascii() else self._any(t) for t in texts]
        fresh = list(set().union(*parts).difference(self.known))
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        hard = []
        for piece, b in zip(fresh, raw, strict=True):
            whole = self.ranks.get(b)
            if whole is None:
                hard.append((piece, b))
            else:
                self.known[piece] = (whole,)
        if hard:
            self.known.update(zip([p for p, _ in hard], rank_queue_merge([b for _, b in hard], self.ranks, self.pairs), strict=True))
        self.chars += sum(map(len, fresh))
        return parts

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = self.split(texts)
        look = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(look, p)), np.int32) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        """Of a text of any length, in segments."""
        return np.concatenate([self.encode_batch([s])[0] for s in segments(text)])

    def count_batch(self, texts: list[str]) -> list[int]:
        parts = self.split(texts)
        look = self.known.__getitem__
        return [sum(map(len, map(look, p))) for p in parts]

    def count(self, text: str) -> int:
        return sum(self.count_batch([s])[0] for s in segments(text))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Of about a chunk of texts; long ones stand alone in theirs."""
        return [self.encode(texts[0])] if len(texts) == 1 else self.encode_batch(texts)

    def count_all(self, texts: list[str]) -> list[int]:
        return [self.count(texts[0])] if len(texts) == 1 else self.count_batch(texts)


def segments(text: str, chars: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text cut where white space follows something else: no pre-token spans such a place."""
    at = 0
    while len(text) - at > 2 * chars and (m := _BORDER.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def text_chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts, about so many characters at a time; longer ones alone."""
    chunk, held = [], 0
    for t in texts:
        if len(t) >= chars and chunk:
            yield chunk
            chunk, held = [], 0
        chunk.append(t)
        held += len(t)
        if held >= chars:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(content: Broadcast) -> Encoder:
    """One encoder per worker process and vocabulary."""
    raw = content.value
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(raw))
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The rank file as a broadcast: its size is that of the vocabulary (under 1 MB), not of the data."""
    with open(path or os.path.join(TOKENIZER_DIR, BYTE_BPE_50K), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row, without special tokens.

    Defined cases: a null or empty text has the empty list; a null id stays
    null; repeated rows are encoded each; strings that name special tokens are
    ordinary text; any other columns, whatever their names, are not read.
    No shuffle: one pass over the scan.
    """
    content = vocabulary(df.sparkSession, vocabulary_path)
    source = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(content)
        for batch in batches:
            keys, begin = batch.column(0), 0
            for chunk in text_chunks([t or "" for t in batch.column(1).to_pylist()]):
                parts = encoder.encode_all(chunk)
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(parts)), ids], names=["doc_id", "ids"])
                begin += len(parts)

    return spread(source).mapInArrow(run, schema)


def decoded_digests(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, digest``: the MD5 of the bytes that each row's ids stand for. No shuffle."""
    content = vocabulary(encoded.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in parse_ranks(content.value).items()}
        for batch in batches:
            digests = [md5(b"".join(map(pieces.__getitem__, ids))).hexdigest() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["doc_id", "digest"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, digest string")
