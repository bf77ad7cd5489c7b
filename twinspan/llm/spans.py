"""Long exact spans shared between records.

A sliding paragraph of ``min_bytes`` bytes is stood for by the MinHash of its
``anchor`` byte shingles: one band of one row, the setting with full recall,
because equal paragraphs have equal minima. The shingle that holds the minimum
is the paragraph's anchor, and neighbours share anchors, so about two in
``min_bytes - anchor + 2`` positions are kept. Records that collide in an
anchor are verified over every paragraph around it by a second hash, so a
reported pair agrees in an anchor hash and in a paragraph hash, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.components import connected_components
from twinspan.operators.intervals import merge_intervals
from twinspan.session import cut, spread

MIN_BYTES = 200
ANCHOR = 80
#: Bytes of a text hashed at a time; longer texts are worked off in overlapping segments.
SEGMENT = 1 << 20
#: An anchor with more different surroundings than this is verified by distributed groups.
LOCAL_CONTEXTS = 2000

_M1, _M2, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
_U = np.uint64


class RollingHash:
    """Hashes of any substring of a segment from prefix sums modulo 2**64."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, multiplier: int):
        n = len(data) + 1
        if multiplier not in self._tables or len(self._tables[multiplier][0]) < n:
            size = max(n, 1 << 16)
            inverse = pow(multiplier, -1, 1 << 64)
            self._tables[multiplier] = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, m, _U)])) for m in (multiplier, inverse))
        power, self.inverse = self._tables[multiplier]
        self.prefix = np.zeros(n, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: n - 1], out=self.prefix[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(_MIX)
    return x ^ (x >> _U(29))


def window_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some window, ascending."""
    bits = _U(max(1, len(values) - 1).bit_length())
    low = (_U(1) << bits) - _U(1)
    m = (values & ~low) | np.arange(len(values), dtype=_U)
    size = 1
    while 2 * size <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < window:
        m = np.minimum(m[: len(m) - (window - size)], m[window - size :])
    at = (m & low).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def anchor_places(data: np.ndarray, min_bytes: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of all paragraphs' bytes around it, position, of every anchor."""
    n, reach, window = len(data), min_bytes - anchor, min_bytes - anchor + 1
    found = []
    for begin in range(0, max(1, n - min_bytes + 1), SEGMENT):
        # paragraphs that start in this segment, with the context of their anchors
        lo = max(0, begin - reach)
        seg = data[lo : min(n, begin + SEGMENT + min_bytes + reach)]
        own = data[begin : min(n, begin + SEGMENT + min_bytes - 1)]
        if len(own) < min_bytes:
            continue
        h = RollingHash(own, _M1).all(anchor)
        p = window_argmin(h, window)
        fp = h[p]
        context = RollingHash(seg, _M2)
        at = p + (begin - lo)
        start = np.maximum(at - reach, 0)
        end = np.minimum(at + anchor + reach, len(seg))
        ctx = mix(context.at(start, end - start) + (at - start).astype(_U) * _U(_M1) + (end - start).astype(_U) * _U(_MIX))
        found.append((fp, ctx, p + begin))
    if not found:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
    fp, ctx, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    return fp, ctx, pos


def anchors_of(data: np.ndarray, min_bytes: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of all paragraphs' bytes around it, first position; distinct by both hashes."""
    fp, ctx, pos = anchor_places(data, min_bytes, anchor)
    _, once = np.unique(fp ^ (ctx * _U(3)), return_index=True)
    return fp[once].view(np.int64), ctx[once].view(np.int64), pos[once]


def anchor_runs(data: np.ndarray, min_bytes: int, anchor: int) -> tuple[np.ndarray, ...]:
    """As :func:`anchors_of`, and the first and last position of each run of places.

    Places of one anchor and surrounding at most ``min_bytes`` apart are one
    run: what is shared around each of them is at least that long, so nothing
    between them is left out.
    """
    fp, ctx, pos = anchor_places(data, min_bytes, anchor)
    key = fp ^ (ctx * _U(3))
    order = np.lexsort((pos, key))
    fp, ctx, pos, key = fp[order], ctx[order], pos[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = new.copy()
    start[1:] |= np.diff(pos) > min_bytes
    once = pos[new][np.cumsum(new) - 1]
    last = pos[np.append(np.flatnonzero(start)[1:], len(pos)) - 1] if len(pos) else pos
    return fp[start].view(np.int64), ctx[start].view(np.int64), once[start], pos[start], last


def local_cliques(contexts: list[np.ndarray], left: list[int], min_bytes: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Among surroundings of one anchor, each set that shares a paragraph.

    ``left`` is the number of bytes before the anchor. Yields a group hash,
    the members and, as offsets from the anchor, the first and the last byte
    that they share. Each set of members comes once.
    """
    hashes, whose, offset = [], [], []
    for i, (data, before) in enumerate(zip(contexts, left, strict=True)):
        if len(data) >= min_bytes:
            h = RollingHash(data, _M2).all(min_bytes)
            hashes.append(h)
            whose.append(np.full(len(h), i))
            offset.append(np.arange(len(h)) - before)
    if not hashes:
        return
    h, w, o = np.concatenate(hashes), np.concatenate(whose), np.concatenate(offset)
    order = np.lexsort((w, h, o))
    h, w, o = h[order], w[order], o[order]
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    size = np.diff(np.append(edge, len(h)))
    found: dict[bytes, list] = {}
    for e, n in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = w[e : e + n]
        at = int(o[e])
        kept = found.setdefault(members.tobytes(), [int(h[e].view(np.int64)), members, at, at])
        kept[2], kept[3] = min(kept[2], at), max(kept[3], at)
    for key, members, lo, hi in found.values():
        yield key, members, lo, hi + min_bytes - 1


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each string of an Arrow array, without copies."""
    large = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b]


_ANCHORS = "fp bigint, ctx bigint, c bigint, pos int, kind tinyint"
_RUNS = "fp bigint, ctx bigint, c bigint, pos int, first int, last int, kind tinyint"
_AROUND = "fp bigint, ctx bigint, before int, hot boolean, context binary"
_CLIQUES = "fp bigint, key bigint, ctx bigint, lo int, hi int"
#: Kinds of anchor rows: met once in its batch, the first of several texts there, another of them.
ONCE, FIRST, MORE = 0, 1, 2
#: The list of places to look at is broadcast up to so many.
BROADCAST_PLACES = 400_000


def _names(schema: str) -> list[str]:
    return [n.split()[0] for n in schema.split(", ")]


def _batch(columns: list[np.ndarray] | tuple[np.ndarray, ...], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_names(schema))


def batch_kinds(fp: np.ndarray, ctx: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Kind of each row; rows of one anchor and surrounding in the first of its texts are no more than one."""
    key = fp.view(_U) ^ (ctx.view(_U) * _U(3))
    order = np.argsort(key, kind="stable")
    k, cs = key[order], c[order]
    start = np.ones(len(k), bool)
    start[1:] = k[1:] != k[:-1]
    group = np.cumsum(start) - 1
    other = cs != cs[start][group]
    several = np.bincount(group, weights=other, minlength=int(start.sum())) > 0 if len(k) else start
    kinds = np.empty(len(k), np.int8)
    kinds[order] = np.where(other, MORE, np.where(several[group], FIRST, ONCE))
    return kinds


def shared_rows(batches: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Of rows sorted by their first column (columns fp, ctx, c, ..., kind) those whose fp stands in several texts.

    An anchor's rows are held back only while all are of one text.
    """
    held: list[np.ndarray] | None = None
    open_fp = None  # an anchor known to be shared that may go on in the next batch
    for rows in batches:
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            held = None
        fp, c, kind = rows[0], rows[2], rows[-1]
        if not len(fp):
            continue
        start = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        several = (np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)) | (np.maximum.reduceat(kind, start) > ONCE)
        if open_fp is not None and fp[0] == open_fp:
            several[0] = True
        keep = np.repeat(several, np.diff(np.append(start, len(fp))))
        if several[-1]:
            open_fp = fp[-1]
        else:
            tail = slice(start[-1], None)
            _, once = np.unique(np.stack([x[tail] for x in rows[1:-1]]), axis=1, return_index=True)  # copies of the text
            held = [x[tail][np.sort(once)] for x in rows]
        yield [x[keep] for x in rows]


def anchor_hits(docs: DataFrame, min_bytes: int, anchor: int, runs: bool = False) -> DataFrame:
    """``fp, ctx, c, pos``: anchors that several texts hold, with their first place in a text.

    With ``runs`` a row for each run of places, ``first`` to ``last``; that
    with ``first = pos`` is the first.

    Anchors are made once and cross one exchange. The first text of an anchor
    and surrounding in a batch goes to the anchor's task, the other ones are
    known to share it already and are spread, so a hot anchor is one row per
    batch there.
    """
    schema = _RUNS if runs else _ANCHORS
    count = schema.count(",")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_numpy()
            rows, seen = [], set()
            for c, data in zip(classes.tolist(), _bytes(batch.column(1)), strict=True):
                if c in seen:
                    continue
                seen.add(c)
                fp, ctx, *places = (anchor_runs if runs else anchors_of)(data, min_bytes, anchor)
                rows.append((fp, ctx, np.full(len(fp), c, np.int64), *(x.astype(np.int32) for x in places)))
            if rows:
                columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
                yield _batch([*columns, batch_kinds(*columns[:3])], schema)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: list[list[np.ndarray]] = []

        def once() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                rest = rows[-1] == MORE
                more.append([x[rest] for x in rows])
                yield [x[~rest] for x in rows]

        for rows in shared_rows(once()):
            for part in (*more, rows):
                yield _batch(part[:count], ", ".join(schema.split(", ")[:count]))
            more.clear()
        for part in more:
            yield _batch(part[:count], ", ".join(schema.split(", ")[:count]))

    anchors = spread(docs.select("c", "text")).mapInArrow(find, schema)
    dealt = anchors.repartition(F.when(F.col("kind") == MORE, F.xxhash64("c", "fp")).otherwise(F.col("fp"))).sortWithinPartitions("fp")
    return cut(dealt.mapInArrow(select, ", ".join(schema.split(", ")[:count])).distinct())


def shared_groups(docs: DataFrame, min_bytes: int, anchor: int, local: int = LOCAL_CONTEXTS) -> DataFrame:
    """``k1, k2, c, lo, hi``: classes of texts with the same group key hold the same bytes.

    ``docs`` has doc_id, c (hash of the text) and text; exact copies have one
    class, so copies cost nothing after the first shuffle's map side. ``lo``
    and ``hi`` are the first and last shared byte; ``hi`` may lie behind the
    end of the text. Of equal surroundings in one text the first stands for
    all, which is enough to tell pairs; :func:`shared_spans` has every place.
    """
    return confirmed_groups(docs, anchor_hits(docs, min_bytes, anchor), min_bytes, anchor, local).drop("pos")


def shared_spans(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """``c, lo, hi``: all shared bytes of each class, from the groups and the hits with runs they come from."""
    shared = groups.groupBy("k1", "k2").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k1", "k2")
    spans = groups.join(shared, ["k1", "k2"], "left_semi").select(F.col("k1").alias("fp"), "c", "pos", "lo", "hi")
    again = hits.filter("last > pos").select("fp", "c", "pos", "first", "last")
    moved = spans.join(again, ["fp", "c", "pos"]).select("c", (F.col("lo") + F.col("first") - F.col("pos")).alias("lo"), (F.col("hi") + F.col("last") - F.col("pos")).alias("hi"))
    return spans.select("c", "lo", "hi").unionByName(moved)


def confirmed_groups(docs: DataFrame, hits: DataFrame, min_bytes: int, anchor: int, local: int = LOCAL_CONTEXTS) -> DataFrame:
    """The groups of :func:`shared_groups` with ``pos``, the place of the anchor (k1), from hits of one row per surrounding.

    Texts with one anchor and surrounding share all of it: a group by itself.
    Where an anchor has several surroundings, one text of each is looked at,
    what they share is found among the surroundings, and the groups are spread
    to all texts that have them. So the cost does not grow with the copies.
    """
    reach = min_bytes - anchor
    whole = hits.select(F.col("fp").alias("k1"), F.col("ctx").alias("k2"), "c", "pos", F.greatest(F.lit(0), F.col("pos") - reach).alias("lo"), (F.col("pos") + min_bytes - 1).alias("hi"))
    kinds = cut(hits.groupBy("fp", "ctx").agg(F.min(F.struct("c", "pos")).alias("r")).select("fp", "ctx", "r.c", "r.pos"))
    several = kinds.groupBy("fp").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    looked_at = kinds.join(several, "fp")
    todo = looked_at.groupBy("c").agg(F.collect_list(F.struct("fp", "ctx", "pos", (F.col("contexts") > local).alias("hot"))).alias("at"))
    first = docs.groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    todo = cut(todo.join(first, "c").select(F.col("c").alias("wc"), F.col("doc_id").alias("wid"), "at"))
    few = todo.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] <= BROADCAST_PLACES
    looked = docs.join(F.broadcast(todo) if few else todo, (F.col("doc_id") == F.col("wid")) & (F.col("c") == F.col("wc"))).select("c", "text", F.col("at.fp").alias("fps"), F.col("at.ctx").alias("ctxs"), F.col("at.pos").alias("ats"), F.col("at.hot").alias("hots"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = ([], [], [], [], []), set()
            lists = zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), *batch.columns[2:], strict=True)
            for c, data, fps, ctxs, ats, hots in lists:
                if c in seen:
                    continue
                seen.add(c)
                for fp, ctx, pos, spread in zip(fps.as_py(), ctxs.as_py(), ats.as_py(), hots.as_py(), strict=True):
                    a = max(0, pos - reach)
                    for column, value in zip(out, (fp, ctx, pos - a, spread, data[a : pos + min_bytes].tobytes()), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=_names(_AROUND))

    # an anchor with few surroundings goes to one task; a hot one is spread and grouped by paragraph
    around = looked.mapInArrow(surroundings, _AROUND).repartition("fp", F.when(F.col("hot"), F.pmod(F.col("ctx"), F.lit(1024)))).sortWithinPartitions("fp")

    def cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        held_fp = None

        def group() -> list[tuple]:
            ctx = np.array(list(held), np.int64)
            found = local_cliques([np.frombuffer(x[1], np.uint8) for x in held.values()], [x[0] for x in held.values()], min_bytes, anchor)
            return [(np.full(len(m), held_fp), np.full(len(m), key), ctx[m], np.full(len(m), lo, np.int32), np.full(len(m), hi, np.int32)) for key, m, lo, hi in found]

        for batch in batches:
            rows = []
            for fp, ctx, before, hot, context in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and fp != held_fp:
                    rows += group()
                    held = {}
                if not hot:
                    held_fp = fp
                    held[ctx] = (before, context)
                elif len(context) >= min_bytes:
                    h = RollingHash(np.frombuffer(context, np.uint8), _M2).all(min_bytes).view(np.int64)
                    lo = (np.arange(len(h)) - before).astype(np.int32)
                    rows.append((np.full(len(h), fp), h, np.full(len(h), ctx), lo, lo + np.int32(min_bytes - 1)))
            if rows:
                yield _batch([np.concatenate(x) for x in zip(*rows, strict=True)], _CLIQUES)
        if held and (rows := group()):
            yield _batch([np.concatenate(x) for x in zip(*rows, strict=True)], _CLIQUES)

    found = cut(around.mapInArrow(cliques, _CLIQUES))
    real = found.groupBy("fp", "key").agg(F.min("ctx").alias("a"), F.max("ctx").alias("z")).filter("a <> z").select("fp", "key")
    parts = found.join(real, ["fp", "key"]).join(hits.select("fp", "ctx", "c", "pos"), ["fp", "ctx"])
    return whole.unionByName(parts.select(F.col("fp").alias("k1"), F.col("key").alias("k2"), "c", "pos", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi")))


def kept_groups(groups: DataFrame) -> DataFrame:
    """``g, c``: members of the groups of several classes; of groups with the same members one stands for all."""
    sign = groups.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("x"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    kept = sign.groupBy("n", "x", "lo", "hi").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    return groups.join(kept, ["k1", "k2"], "left_semi").select(F.xxhash64("k1", "k2").alias("g"), "c")


def class_pairs(groups: DataFrame) -> DataFrame:
    """``a, b``: pairs of classes with a common group, each once.

    A long span costs one join row per pair and not one per paragraph, since
    groups with the same members are one clique.
    """
    rows = kept_groups(groups)
    return rows.withColumnRenamed("c", "a").join(rows.withColumnRenamed("c", "b"), "g").filter("a < b").select("a", "b").distinct()


def link_counts(rows: DataFrame) -> DataFrame:
    """``c, links``: how many other classes each one shares a group with, from ``g, c``.

    The largest group of a class counts by its size. Of its other groups only
    the members outside the largest one count, and those are found once for
    each two groups, not for each class. So groups within each other, as the
    parts of a header that most texts have, are never made into pairs.
    """
    sized = rows.join(rows.groupBy("g").agg(F.count("*").alias("n")), "g")
    largest = sized.groupBy("c").agg(F.max(F.struct("n", "g")).alias("m"), F.count("*").alias("groups")).select("c", F.col("m.g").alias("top"), F.col("m.n").alias("n"), "groups")
    rest = rows.join(largest.filter("groups > 1").select("c", "top"), "c").filter("g <> top").select("g", "c", "top")
    outside = rest.select("g", "top").distinct().join(rows.withColumnRenamed("c", "d"), "g").join(rows.select(F.col("g").alias("top"), F.col("c").alias("d")), ["top", "d"], "left_anti")
    new = rest.join(outside, ["g", "top"]).select("c", "d").distinct().groupBy("c").agg(F.count("*").alias("more"))
    return largest.join(new, "c", "left").select("c", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))


def prepared(df: DataFrame, doc_id: str, text: str, min_bytes: int) -> DataFrame:
    return (
        df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
        .filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_bytes))
        .select("doc_id", F.xxhash64("text").alias("c"), "text")
    )


def shared_span_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, anchor: int = ANCHOR) -> DataFrame:
    """``doc_a < doc_b`` of all records that hold the same ``min_bytes`` bytes of UTF-8.

    Defined cases: null ids, null texts and texts shorter than the span have
    no pair; repeated rows count once; one id with several texts holds all of
    them and is no pair with itself; a span repeated inside one record alone
    is none; an empty table gives none; other columns are not read.
    """
    docs = prepared(df, doc_id, text, min_bytes)
    members = docs.select("c", "doc_id").distinct()
    pairs = class_pairs(cut(shared_groups(docs, min_bytes, anchor)))
    apart = pairs.join(members.select(F.col("c").alias("a"), F.col("doc_id").alias("x")), "a").join(members.select(F.col("c").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    copies = members.groupBy("c").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q")).filter("p <> q").select("c")
    same = members.join(copies, "c", "left_semi")
    alike = same.withColumnRenamed("doc_id", "x").join(same.withColumnRenamed("doc_id", "y"), "c").filter("x < y").select("x", "y")
    return apart.unionByName(alike).filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_share(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, anchor: int = ANCHOR) -> DataFrame:
    """How much of each record stands in other records too.

    One row per record with a text of at least ``min_bytes``: ``doc_id,
    class_id`` (smallest id of its component of linked records), ``links``
    (different texts it shares a span with), ``copies`` (other ids with the
    same text), ``n_bytes, shared_bytes, share``. Cases as in
    :func:`shared_span_pairs`.
    """
    docs = prepared(df, doc_id, text, min_bytes)
    classes = docs.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n"), F.max(F.octet_length("text")).alias("n_bytes"))
    hits = anchor_hits(docs, min_bytes, anchor, runs=True)
    groups = cut(confirmed_groups(docs, hits.filter("first = pos").select("fp", "ctx", "c", "pos"), min_bytes, anchor))
    rows = cut(kept_groups(groups))
    periods = merge_intervals(shared_spans(groups, hits), "c", "lo", "hi").filter("range_kind = 'period'")
    covered = periods.join(classes.select("c", "n_bytes"), "c").groupBy("c").agg(F.sum(F.least("hi", F.col("n_bytes") - 1) - F.col("lo") + 1).alias("covered"))
    degree = link_counts(rows)
    stars = rows.join(rows.groupBy("g").agg(F.min("c").alias("least")), "g")
    parts = connected_components(stars, "c", "least").withColumnRenamed("node", "c")
    named = classes.join(parts, "c", "left").withColumn("component", F.coalesce("component", "c"))
    ids = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    per = named.join(ids, "component").join(degree, "c", "left").join(covered, "c", "left")
    return docs.select("doc_id", "c").distinct().join(per, "c").select(
        "doc_id",
        "class_id",
        F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("n") - 1).alias("copies"),
        "n_bytes",
        F.when(F.col("n") > 1, F.col("n_bytes")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_bytes"),
        (F.when(F.col("n") > 1, F.col("n_bytes")).otherwise(F.coalesce("covered", F.lit(0))) / F.col("n_bytes")).alias("share"),
    )
