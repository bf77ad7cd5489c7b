"""Filling fixed-capacity containers by conflict-constrained best fit.

Bins stand ordered by what they have left: one bitmap over residuals for all
bins, and for every source and every frequent duplicate cluster one of the
residuals all of whose bins hold it, so the successor search for the tightest
compatible bin is a find-first-set over their difference. Bins of a residual
are grouped by their bitmap of sources and frequent clusters; rare clusters
are looked up in the bin. The search goes on to the next wider residual until
a bin is compatible. Where none is, a new bin is opened as long as the items'
total asks for more bins than there are; beyond that conflicts are only
preferences and the tightest bin with room is taken, so that no container is
spent on a conflict (the project asks for as few containers as possible).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspan.llm.bpe import text_chunks, vocabulary, worker_encoder
from twinspan.session import cut, spread

#: Items that one best-fit run sorts and holds.
RUN_ITEMS = 20_000
#: A duplicate cluster with more items in a run has a bit of its own; of others at most so many bins are passed over.
FREQUENT = 16
#: A container with more unused tokens than this is opened again and repacked.
REPACK_ABOVE = 0
#: Shards of the repacking hold about so many items.
REPACK_ITEMS = 100_000


class Bins:
    """Open bins by residual and bitmap of tags, with the residuals where every bin holds a tag."""

    def __init__(self, capacity: int):
        self.held: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.total = [0] * (capacity + 1)
        self.having: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # bins with a tag
        self.mask = 0
        self.full: dict[int, int] = {}  # by tag: residuals all of whose bins hold it

    def add(self, residual: int, bits: int, tags: set[int], b: int) -> None:
        self.held[residual].setdefault(bits, []).append(b)
        having, bit = self.having[residual], 1 << residual
        before = self.total[residual]
        self.total[residual] = before + 1
        self.mask |= bit
        if before:
            for tag in [t for t, n in having.items() if n == before and t not in tags]:
                self.full[tag] &= ~bit
        for tag in tags:
            n = having[tag] = having.get(tag, 0) + 1
            if n == before + 1:
                self.full[tag] = self.full.get(tag, 0) | bit

    def take(self, residual: int, bits: int, at: int, tags: list[set[int]]) -> int:
        bins = self.held[residual][bits]
        b = bins[at]
        bins[at] = bins[-1]
        bins.pop()
        if not bins:
            del self.held[residual][bits]
        having, bit = self.having[residual], 1 << residual
        left = self.total[residual] = self.total[residual] - 1
        for tag in tags[b]:
            having[tag] -= 1
            if not having[tag]:
                del having[tag]
                self.full[tag] = self.full.get(tag, 0) & ~bit
        if not left:
            self.mask &= ~bit
        else:
            for tag, n in having.items():
                if n == left:
                    self.full[tag] = self.full.get(tag, 0) | bit
        return b


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item (sizes 1..capacity), largest first; and the bin count."""
    bound = -(-int(sizes.sum()) // capacity)  # so many bins are needed anyway
    bin_of = np.empty(len(sizes), np.int64)
    names, slots = np.unique(sources, return_inverse=True)
    _, cluster_of, often = np.unique(clusters, return_inverse=True, return_counts=True)
    frequent = np.full(len(often), -1, np.int64)
    frequent[often > FREQUENT] = len(names) + np.arange(int((often > FREQUENT).sum()))
    hot = frequent[cluster_of]
    open_, tags = Bins(capacity), []
    inside: list[set[int]] = []  # rare duplicate clusters by bin
    order = np.argsort(-sizes, kind="stable")
    for i, size, slot, cluster, tag in zip(order.tolist(), sizes[order].tolist(), slots[order].tolist(), cluster_of[order].tolist(), hot[order].tolist(), strict=True):
        bit = 1 << slot | (1 << tag if tag >= 0 else 0)
        pick = None
        fits, base = (open_.mask & ~open_.full.get(slot, 0) & ~open_.full.get(tag, 0)) >> size, size
        while fits and pick is None:
            step = (fits & -fits).bit_length() - 1
            residual = base + step
            for bits, bins in open_.held[residual].items():
                if not bits & bit:
                    pick = next(((residual, bits, at) for at in range(len(bins) - 1, -1, -1) if cluster not in inside[bins[at]]), None)
                    if pick:
                        break
            fits >>= step + 1
            base = residual + 1
        if pick is None and len(inside) >= bound and open_.mask >> size:  # every bin with room conflicts: the tightest one
            fits = open_.mask >> size
            residual = size + (fits & -fits).bit_length() - 1
            bits, bins = next(iter(open_.held[residual].items()))
            pick = (residual, bits, len(bins) - 1)
        if pick is None:
            b, residual, bits = len(inside), capacity, 0
            inside.append(set())
            tags.append(set())
        else:
            residual, bits, at = pick
            b = open_.take(residual, bits, at, tags)
        bin_of[i] = b
        tags[b].add(slot)
        if tag >= 0:
            tags[b].add(tag)
        else:
            inside[b].add(cluster)
        if residual > size:
            open_.add(residual - size, bits | bit, tags[b], b)
    return bin_of, len(inside)


_PIECES = T.StructType(
    [
        T.StructField("container", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("src", T.LongType()),
        T.StructField("dup", T.LongType()),
        T.StructField("full", T.BooleanType()),
    ]
)


def _table(container, doc, first, n, src, dup, capacity: int) -> pa.RecordBatch:
    held = np.bincount(container - container.min(), weights=n).astype(np.int64)[container - container.min()] if len(container) else n
    arrays = [container, doc, first, n, src, dup, capacity - held <= REPACK_ABOVE]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays[:1]] + [doc if isinstance(doc, pa.Array) else pa.array(doc)] + [pa.array(x) for x in arrays[2:]], names=[f.name for f in _PIECES])


def pack_corpus(df: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary_path: str | None = None) -> DataFrame:
    """``container, doc_id, first_token, n_tokens`` of every piece."""
    return packed(df, capacity, doc_id, text, source, vocabulary_path).select("container", "doc_id", "first_token", "n_tokens")


def conflicts(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row on :func:`packed`: containers, tokens, the least number of containers, and the conflicts that remain.

    ``with_source`` and ``with_copy`` count containers that hold two items of
    a source, or of a duplicate cluster; pieces of one document are one item.
    """
    per = pieces.groupBy("container").agg(*[F.count_distinct(c).alias(c) for c in ("doc_id", "src", "dup")], F.sum("n_tokens").alias("t"))  # at most ``capacity`` rows each
    tokens = F.coalesce(F.sum("t"), F.lit(0))
    return per.agg(
        F.count("*").alias("containers"), tokens.alias("tokens"), F.ceil(tokens / capacity).alias("least"), F.count_if(F.col("doc_id") > F.col("src")).alias("with_source"), F.count_if(F.col("doc_id") > F.col("dup")).alias("with_copy")
    )


def totals(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row on :func:`packed` of documents with unique ids: how many there are, and how many break a rule (0 of each is right)."""
    pieces = cut(pieces)
    full = pieces.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("too_full"))
    last = F.max(F.col("first_token") + F.col("n_tokens"))
    per = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), last.alias("last"), F.min("first_token").alias("first"), F.count_distinct("first_token").alias("parts"), F.count("*").alias("n"))
    told = per.agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("t") != F.col("last")) | (F.col("first") != 0) | (F.col("parts") != F.col("n"))).alias("not_once"),
        F.count_if((F.col("t") <= capacity) & (F.col("n") > 1)).alias("cut_small"),
    )
    return told.join(full).select("documents", "too_full", "not_once", "cut_small")  # one row each


def packed(df: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary_path: str | None = None) -> DataFrame:
    """The pieces of :func:`pack_corpus` with ``src`` and ``dup``, the hashes of source and text.

    Defined cases: a document larger than the capacity fills whole containers
    of its own and its rest is packed as an item; no other document is cut;
    documents without tokens (null, empty) are left out; repeated rows are
    items of their own; a null source is a source of its own; an empty table
    gives no container; other columns are not read. Container ids are unique,
    not dense.

    Plan: one pass over the scan tokenizes and packs each partition in runs of
    bounded size; the pieces (five numbers each) are kept in a reliable
    checkpoint; those of containers with room left are spread by a hash over
    shards of bounded size and packed again, together with the small rests of
    other partitions.
    """
    spark = df.sparkSession
    content = vocabulary(spark, vocabulary_path)
    inputs = df.select(
        df[doc_id].cast("bigint").alias("doc_id"),
        df[text].alias("text"),
        F.xxhash64(df[source]).alias("src"),
        F.xxhash64(df[text]).alias("dup"),
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(content)
        bins = TaskContext.get().partitionId() << 36
        keys, counts, srcs, dups, held = [], [], [], [], 0

        def run() -> pa.RecordBatch:
            nonlocal bins
            doc = pa.concat_arrays(keys)
            n = np.concatenate(counts)
            src, dup = np.concatenate(srcs), np.concatenate(dups)
            whole = n // capacity
            rest = n - whole * capacity
            at = np.flatnonzero(rest > 0)
            bin_of, used = best_fit(rest[at], src[at], dup[at], capacity)
            rep = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(whole) - whole, whole)
            container = bins + np.concatenate([bin_of, used + np.arange(len(rep))])
            bins += used + len(rep)
            rows = np.concatenate([at, rep])
            return _table(
                container,
                doc.take(pa.array(rows)),
                np.concatenate([whole[at] * capacity, nth * capacity]),
                np.concatenate([rest[at], np.full(len(rep), capacity)]),
                src[rows],
                dup[rows],
                capacity,
            )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts.append(np.array([n for chunk in text_chunks(texts) for n in encoder.count_all(chunk)], np.int64))
            keys.append(batch.column(0))
            srcs.append(batch.column(2).to_numpy(zero_copy_only=False))
            dups.append(batch.column(3).to_numpy(zero_copy_only=False))
            held += len(texts)
            if held >= RUN_ITEMS:
                yield run()
                keys, counts, srcs, dups, held = [], [], [], [], 0
        if held:
            yield run()

    pieces = cut(spread(inputs).mapInArrow(first, _PIECES))
    loose = pieces.filter("NOT full")
    shards = max(1, -(-loose.count() // REPACK_ITEMS))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        n, src, dup = (t.column(c).to_numpy() for c in ("n_tokens", "src", "dup"))
        bin_of, _ = best_fit(n, src, dup, capacity)
        container = (1 << 62 | TaskContext.get().partitionId() << 36) + bin_of
        yield _table(container, t.column("doc_id").combine_chunks(), t.column("first_token").to_numpy(), n, src, dup, capacity)

    dealt = loose.repartition(shards, F.xxhash64("container", "doc_id", "first_token"))
    out = ["container", "doc_id", "first_token", "n_tokens", "src", "dup"]
    return pieces.filter("full").select(*out).unionByName(dealt.mapInArrow(again, _PIECES).select(*out))
