"""Generated, minified, third-party and data files among source files.

Every file is cut into shingles of five tokens with its names masked, and two
kinds of cluster are made of them, each by MinHash bands with verification by
exact similarity and connected components:

* copies: bands over the shingles that carry evidence (a literal), because
  once names are masked the rest is common to all code; verified on all masked
  shingles and on the evidence. A file with little evidence is banded and
  verified with its names. Clusters across repositories are third-party code
  where a member bears a third-party mark and none the mark of a sister
  repository; copies of a generated file in its repository are its family.
* forms: bands over shingles with literals masked too, of regular files, whose
  shingles recur. Clusters of little but literals are data blobs, those of
  dense lines minified code, those with a family within a repository generated.

Marks in path and head seed the copies and explain; alone they decide only
for files that no cluster speaks of, and so does the form of a single file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.llm.origin import code_of, dense_share, form_kind, head_kind, is_evidence, is_packed, path_kind, tokens_of
from twinspan.operators.components import connected_components
from twinspan.session import cut, spread

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares one of so many bands of so many rows with probability above 0.9999998.
BANDS, ROWS = 40, 5
#: With fewer shingles of evidence a file is compared with its names; up to the second number it has both kinds of band.
LITTLE_EVIDENCE, SOME_EVIDENCE = 8, 10
#: Buckets up to this size are compared pair by pair (copies: few share a bucket by chance; forms: many do); in larger ones all meet some
#: leaders, so many at first and four times as many each round.
COPY_PAIRWISE, PAIRWISE, LEADERS = 256, 6, 4
#: Jaccard distance is a metric: a set less similar than NEAR to a leader has no link to what is linked with that leader, and two linked
#: sets are as similar to a leader up to APART.
NEAR, APART = 2 * SIMILARITY - 1 - 1e-9, 1 - SIMILARITY + 1e-9
#: Pairs around leaders are compared at once up to so many; more in rounds of growing shares of the members, with components between.
AT_ONCE, SHARES = 1_000_000, (1, 4, 16, 64)
#: A form is regular if its shingles recur so often on average; a family recurs more.
REGULAR, FAMILY = 3.0, 10.0
#: What most files of a cluster of forms must show for a verdict: literals among words, code in dense lines, no runs of bare words (prose).
LITERAL_SHARE, DENSE_SHARE, PROSE_SHARE = 0.75, 0.5, 0.1
#: A side of a join is broadcast up to so many rows of a few numbers each; sets of shingles up to so many numbers together.
BROADCAST_ROWS, BROADCAST_NUMBERS = 50_000, 4_000_000

EXTENSIONS = r"[^/]\.(rs|py|tsx?|js|json)$"
_U = np.uint64
_FACTORS = (np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << _U(1)) | _U(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(max(SHINGLE, ROWS))], dtype=np.uint64)
_SALTS = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)


class TokenTable:
    """What a worker knows of the tokens it has seen, by number: hashes with more and more masked, and their kind.

    Hashes are of 64 bits and the same in every process. A name counts as any
    other name in ``masked``; in ``form`` so do a number and a string.
    """

    def __init__(self, room: int = 1 << 19):
        self.ids: dict[str, int] = {}
        self.plain, self.masked, self.form = (np.zeros(room, _U) for _ in range(3))
        #: 0 other, 1 name, 2 number, 3 string, 4 packed string
        self.kind, self.told = np.zeros(room, np.uint8), np.zeros(room, bool)

    def number(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.ids)
        if len(self.ids) + len(new) > len(self.plain):
            new = set(tokens)
            self.__init__(max(len(self.plain), 2 * len(new)))
        for t in new:
            i = self.ids[t] = len(self.ids)
            kind = 1 if t[0].isalpha() or t[0] == "_" else 2 if t[0].isdigit() else 0 if t[0] not in "\"'" else 4 if is_packed(t) else 3
            whole = _hash(t)
            self.plain[i], self.kind[i], self.told[i] = whole, kind, is_evidence(t)
            self.masked[i] = _MASKS[1] if kind == 1 else whole
            self.form[i] = _MASKS[kind] if kind else whole
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))


def _hash(token: str) -> int:
    return int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: Hashes of a masked name, number and string; no token is spelled so.
_MASKS = [0, _hash(" name"), _hash(" number"), _hash(" string"), _hash(" string")]
#: Used by functions of this module only: a nested function would take a copy of it along to the worker.
_TABLE = TokenTable()


def shingle_runs(h: np.ndarray) -> np.ndarray:
    """Hash of every run of five token hashes, in order; a shorter text is one run."""
    if len(h) < SHINGLE:
        return h[:0] if not len(h) else np.array([(h * _POWERS[: len(h)]).sum(dtype=_U)], _U)
    n = len(h) - SHINGLE + 1
    x = sum((h[k : k + n] * _POWERS[k] for k in range(SHINGLE)), np.zeros(n, _U))
    x ^= x >> _U(31)
    return x * _U(0xBF58476D1CE4E5B9)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of the MinHash signature of a set, the band mixed in."""
    low = np.concatenate([(hashes[:, None] * _FACTORS[None, k : k + 50]).min(0) for k in range(0, BANDS * ROWS, 50)]).reshape(BANDS, ROWS)
    return (((low ^ (low >> _U(29))) * _POWERS[None, :ROWS]).sum(1, dtype=_U) + _SALTS).view(np.int64)


def _digest(hashes: np.ndarray, salt: bytes) -> int:
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8, salt=salt).digest(), "little", signed=True)


def copy_sets(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Copy class, masked runs, evidence (distinct shingles with a telling literal), plain shingles if evidence is short (else none), band keys."""
    masked, plain = _TABLE.masked[ids], _TABLE.plain[ids]
    runs = shingle_runs(masked)
    upto = np.concatenate([[0], np.cumsum(_TABLE.told[ids])])
    size = min(SHINGLE, len(ids))
    told = np.unique(runs[upto[size:] - upto[: len(upto) - size] > 0])
    named = np.unique(shingle_runs(plain)) if len(told) <= SOME_EVIDENCE else runs[:0]
    rich = len(told) >= LITTLE_EVIDENCE
    keys = ([band_keys(told)] if rich else []) + ([band_keys(named) ^ 1] if len(named) else [])
    return _digest(masked, b"names") if rich else _digest(plain, b"plain"), runs, told, named, np.concatenate(keys)


_TYPES = {
    "mark": pa.string(), "ours": pa.bool_(), "alone": pa.string(), "cls": pa.int64(), "keys": pa.list_(pa.int64()), "form": pa.int64(),
    "forms": pa.list_(pa.int64()), "recur": pa.float64(), "literal": pa.float64(), "dense": pa.float64(), "prose": pa.float64(),
}
_FEATURES = "path string, repo string, mark string, ours boolean, alone string, cls bigint, keys array<bigint>, form bigint, forms array<bigint>, recur double, literal double, dense double, prose double"


def features_of(text: str, extension: str, marked: str) -> tuple:
    """The columns of ``_TYPES`` for one file."""
    head = head_kind(text, extension)
    code = code_of(text, extension)
    mark = marked or ("" if head == "ours" else head)
    tokens = tokens_of(code)
    if not tokens:
        return (mark, head == "ours", "", *[None] * 8)
    ids = _TABLE.number(tokens)
    cls, _, _, _, keys = copy_sets(ids)
    runs = shingle_runs(_TABLE.form[ids])
    distinct = np.unique(runs)
    recur, dense = len(runs) / len(distinct), dense_share(code)
    kinds = np.bincount(_TABLE.kind[ids], minlength=5)[1:]
    words = max(1, int(kinds.sum()))
    literal = int(kinds[1] + kinds[3] + (kinds[2] if extension != "json" else 0)) / words
    alone = "minified" if dense > DENSE_SHARE else form_kind(code, extension) if recur >= REGULAR or 2 * literal > 1 or kinds[3] else ""
    same = (mark, head == "ours", alone, cls, keys)
    if recur < REGULAR and dense <= DENSE_SHARE:
        return (*same, *[None] * 6)
    return (*same, _digest(distinct, b"forms"), distinct.view(np.int64), recur, literal, dense, float((runs == _PROSE).mean()))


#: Five names in a row, which no code has.
_PROSE = shingle_runs(np.full(SHINGLE, _MASKS[1], _U))[0]


def file_features(files: DataFrame) -> DataFrame:
    """One row per (path, text) of ``_FEATURES``; forms only of regular files. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(text.as_py(), ext, marked) for ext, marked, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True)]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *arrays], names=["path", "repo", *_TYPES])

    return spread(files.select("path", "ext", "marked", "repo", "text")).mapInArrow(run, _FEATURES)


def sets_of(text: str, extension: str) -> tuple:
    """Copy class, masked shingles, evidence and plain shingles of a text; nulls without tokens."""
    tokens = tokens_of(code_of(text, extension))
    if not tokens:
        return (None,) * 4
    cls, runs, told, named, _ = copy_sets(_TABLE.number(tokens))
    return cls, np.unique(runs).view(np.int64), told.view(np.int64), named.view(np.int64)


def _small(df: DataFrame, *sets: str) -> DataFrame:
    """With a broadcast hint if its rows, or the numbers in its sets, are few enough; counted on checkpointed rows."""
    if sets:
        few = df.agg(F.coalesce(F.sum(sum((F.size(x) for x in sets), F.lit(0))), F.lit(0))).first()[0] <= BROADCAST_NUMBERS
    else:
        few = df.count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def _likeness(a: str, b: str) -> Column:
    """Similarity of two sets, 0 where their sizes alone keep it below NEAR or one is empty."""
    common, near = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)) >= NEAR * F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when(near, 1 / ((F.size(a) + F.size(b)) / F.greatest(common, F.lit(0.5)) - 1)).otherwise(0.0)  # common / union, with one intersection


def measured_copies(files: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of copy classes that are linked or near, on the 64-bit shingles of one text of each.

    ``like`` is their similarity by masked shingles, ``told`` by evidence if
    both have enough of it (else null). What decides for a third class may be
    evidence or names, so a pair is far by these only where no third class
    could be linked to both.
    """
    wanted = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(reps, "cls"))
    texts = files.join(_small(wanted), "path").select("cls", "ext", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for cls, ext, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found = sets_of(text, ext)
                if found[0] == cls:  # a path may have other texts too
                    for column, value in zip(out, found, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in out[1:]]], names=["cls", "masked", "told", "plain"])

    kept = ["masked", "told", "plain"]
    hashed = cut(texts.mapInArrow(sets, "cls bigint, masked array<bigint>, told array<bigint>, plain array<bigint>").groupBy("cls").agg(*[F.first(x).alias(x) for x in kept]))
    hashed = _small(hashed, *kept)
    one, two = hashed.select(F.col("cls").alias("a"), *[F.col(x).alias(x + "1") for x in kept]), hashed.select(F.col("cls").alias("b"), *[F.col(x).alias(x + "2") for x in kept])
    rich1, rich2 = F.size("told1") >= LITTLE_EVIDENCE, F.size("told2") >= LITTLE_EVIDENCE
    met = spread(pairs).join(one, "a").join(two, "b").withColumn("like", _likeness("masked1", "masked2")).filter(F.col("like") >= NEAR)
    met = met.select("a", "b", "like", (rich1 != rich2).alias("mixed"), F.when(rich1 & rich2, _likeness("told1", "told2")).alias("told"), _likeness("plain1", "plain2").alias("names"))
    linked = (F.col("like") >= SIMILARITY) & (F.coalesce("told", "names") >= SIMILARITY)
    return met.filter(F.col("mixed") | (F.greatest("told", "names") >= NEAR)).select("a", "b", linked.alias("linked"), "like", "told")


def bucket_links(keyed: DataFrame, verify: Callable[[DataFrame], DataFrame], pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) that join what all verified pairs of common buckets join; ``keyed`` has key and node, each pair once.

    Small buckets are compared pair by pair. In a larger one, which may hold a
    third of all nodes, every node meets the bucket's leaders, the least nodes
    of each salt, so mostly the same in all buckets of a cluster; those linked
    to a leader are done, the others stay for more leaders, until few are
    left. So a bucket of n nodes in g groups costs about n * g comparisons.

    A node that stays may be linked to one that is done and not to its leader.
    ``verify`` says which: it returns (a, b, linked, like, told), rows with
    linked false where the pair is near (see NEAR), and ``hidden_links``
    compares those with the members of the leader unless they are joined by
    then. A ``verify`` of (a, b) alone says that similarity is transitive.
    """
    left, links, near, members, salts = keyed, [], [], [], LEADERS
    while True:
        sizes = cut(left.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1"))
        pairs = sizes.filter("n = 2").select("a", "b")
        left = cut(left.join(_small(sizes.filter("n > 2").select("key", "n")), "key").select("key", "node", "n"))
        few = left.filter(F.col("n") <= pairwise)
        pairs = pairs.unionByName(few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b"))
        many = left.filter(F.col("n") > pairwise).select("key", "node")
        if many.isEmpty():
            links.append(cut(_measured(verify(cut(pairs.distinct()))).filter("linked").select("a", "b")))
            joined = reduce(DataFrame.unionByName, links)
            return hidden_links(joined, reduce(DataFrame.unionByName, near), reduce(DataFrame.unionByName, members), verify) if near else joined
        leaders = many.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")).agg(F.min("node").alias("lead")).drop("salt")
        met = many.join(leaders, "key").filter("node <> lead")
        found = cut(_measured(verify(cut(pairs.unionByName(met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))).distinct()))))
        links.append(found.filter("linked").select("a", "b"))
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "linked", "like", "told")).withColumnsRenamed({"a": "lead", "b": "node"})
        near.append(both.filter("NOT linked").select("lead", "node", "like", "told"))
        done = cut(leaders.join(both.filter("linked"), "lead").groupBy("key", "node").agg(F.max(F.struct("like", "lead", "told")).alias("m")))
        members.append(done.select("node", "m.*"))
        left = many.join(done.select("key", "node").unionByName(leaders.select("key", F.col("lead").alias("node"))), ["key", "node"], "left_anti")
        salts *= 4


def _measured(found: DataFrame) -> DataFrame:
    return found.select("a", "b", "linked", "like", "told") if "linked" in found.columns else found.select("a", "b", F.lit(True).alias("linked"), F.lit(1.0).alias("like"), F.lit(None).cast("double").alias("told"))


def hidden_links(links: DataFrame, near: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` and those between the members of a leader and nodes near it, found until no pair that could join two components is left.

    ``near`` and ``members`` have lead, node and how similar they are (like,
    told). A pair is left out only where it is in one component by then, or
    where the similarities to the leader are too far apart for a link.
    """
    near = cut(near.distinct())
    if near.isEmpty():
        return links
    part = connected_components(links, "a", "b")
    members = cut(members.select("lead", F.col("node").alias("other"), F.col("like").alias("like2"), F.col("told").alias("told2")).distinct())
    done = 0
    while True:
        part = cut(part)
        near = near.join(part.select(F.col("node").alias("lead"), F.col("component").alias("c")), "lead").join(part, "node", "left")
        near = cut(near.filter(F.col("c") != F.coalesce("component", "node")).select("lead", "node", "like", "told"))
        groups = members.groupBy("lead").agg(F.count("*").alias("n")).join(near.groupBy("lead").agg(F.count("*").alias("m")), "lead")
        total = groups.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        if not total:
            return links
        upto = SHARES[-1] if total <= AT_ONCE else next(x for x in SHARES if x > done)
        slot = F.pmod(F.xxhash64("other"), F.lit(SHARES[-1]))
        pairs = near.join(members.filter((slot >= done) & (slot < upto)), "lead").filter((F.abs(F.col("like") - F.col("like2")) <= APART) & F.coalesce(F.abs(F.col("told") - F.col("told2")) <= APART, F.lit(True)))
        pairs, done = cut(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()), upto
        more = pairs if pairs.isEmpty() else cut(_measured(verify(pairs)).filter("linked").select("a", "b"))
        links = links.unionByName(more)
        if done == SHARES[-1]:
            return links
        if not more.isEmpty():
            part = connected_components(more.unionByName(part.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")


def file_origins(named: DataFrame, documents: DataFrame) -> DataFrame:
    """``path, kind, reason, mark`` of every named path: where its file comes from.

    ``named`` has canonical paths; ``documents`` path and text. kind:
    generated, minified, vendored, blob, or hand (written here or in a sister
    repository). reason: what tells it, of several the first of copies (a
    cluster with a third-party member), literals, dense, family (clusters of
    forms; copies of a generated file of the repository), mark (path or head
    alone), form (of this file alone). mark: what path or head say, or empty.

    Defined cases: null and empty paths have no row; repeated paths have one;
    a path without a text is judged by its names alone; a text without tokens
    is in no cluster; of several texts of a path any may tell; no file is too
    short to be compared; other columns are not read.
    """
    paths = named.select("path").filter("path IS NOT NULL AND path <> ''").distinct().withColumn("by_path", path_kind(F.col("path")))
    files = (
        documents.select("path", "text")
        .filter("path IS NOT NULL AND text IS NOT NULL")
        .select("path", F.regexp_extract(F.col("path"), EXTENSIONS, 1).alias("ext"), path_kind(F.col("path")).alias("marked"), F.substring_index("path", "/", 1).alias("repo"), "text")
        .filter("ext <> ''")
    )
    found = cut(file_features(files))
    classes = found.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("path", "keys")).alias("m"))
    copies = bucket_links(classes.select(F.explode("m.keys").alias("key"), F.col("cls").alias("node")), lambda pairs: measured_copies(files, pairs, classes.select("cls", "m.path")), COPY_PAIRWISE)
    forms = cut(found.filter("form IS NOT NULL").groupBy("form").agg(F.first("forms").alias("forms")))

    sets = _small(forms, "forms")

    def verify(pairs: DataFrame) -> DataFrame:
        met = spread(pairs).join(sets.select(F.col("form").alias("a"), F.col("forms").alias("x")), "a").join(sets.select(F.col("form").alias("b"), F.col("forms").alias("y")), "b")
        met = met.select("a", "b", _likeness("x", "y").alias("like")).filter(F.col("like") >= NEAR)
        return met.select("a", "b", (F.col("like") >= SIMILARITY).alias("linked"), "like", F.lit(None).cast("double").alias("told"))

    similar = bucket_links(form_keys(forms), verify)
    parts = cut(connected_components(copies.unionByName(similar), "a", "b"))
    rows = cut(
        found.select("path", "repo", "mark", "ours", "alone", "cls", "form", "recur", "literal", "dense", "prose")
        .join(parts.select(F.col("node").alias("cls"), F.col("component").alias("copy")), "cls", "left")
        .join(parts.select(F.col("node").alias("form"), F.col("component").alias("like")), "form", "left")
        .withColumn("copy", F.coalesce("copy", "cls"))
        .withColumn("like", F.coalesce("like", "form"))
    )
    return judged(paths, rows)


def form_keys(forms: DataFrame) -> DataFrame:
    """``key, node``: the bands of each set of form shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(hashes.values.to_numpy().view(np.uint64))), pa.array([node] * BANDS, pa.int64())], names=["key", "node"])

    return forms.select("form", "forms").mapInArrow(run, "key bigint, node bigint")


def _told(rank: int, kind: Column, reason: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), kind.cast("string").alias("kind"), reason.cast("string").alias("reason"))


def judged(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """The verdicts of the clusters of copies and forms, joined back to the named paths."""
    third = (F.col("mark") == "vendored") & ~F.col("ours")
    outside = rows.filter("copy IS NOT NULL").groupBy("copy").agg(F.max(third).alias("third"), F.max("ours").alias("sister"), F.min("path").alias("lo"), F.max("path").alias("hi")).filter("third AND NOT sister AND lo <> hi").select("copy", F.lit(True).alias("third"))
    made = rows.filter("copy IS NOT NULL").groupBy("copy", "repo").agg(F.max(F.col("mark") == "generated").alias("made"), F.min("path").alias("lo"), F.max("path").alias("hi")).filter("made AND lo <> hi").select("copy", "repo", F.lit(True).alias("made"))
    text = F.col("prose") >= PROSE_SHARE
    votes = {"dense": F.col("dense") > DENSE_SHARE, "literals": (F.col("literal") >= LITERAL_SHARE) & ~text, "family": (F.col("recur") >= FAMILY) & ~text}
    homes = rows.filter("like IS NOT NULL").groupBy("like", "repo").agg(F.count("*").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi"), *[F.count_if(v).alias(k) for k, v in votes.items()])
    most = homes.groupBy("like").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.col("lo") != F.col("hi")).alias("within"), *[(2 * F.sum(k) > F.sum("n")).alias(k) for k in votes]).filter("lo <> hi")
    verdict = F.when(F.col("dense"), "dense").when(F.col("literals"), "literals").when(F.col("family") & F.col("within"), "family")
    verdicts = most.select("like", verdict.alias("verdict")).filter("verdict IS NOT NULL")
    told = rows.join(outside, "copy", "left").join(made, ["copy", "repo"], "left").join(verdicts, "like", "left")
    kind = F.when(F.col("verdict") == "dense", "minified").when(F.col("verdict") == "literals", "blob").otherwise("generated")
    best = (
        F.when(F.col("third"), _told(6, F.lit("vendored"), F.lit("copies")))
        .when(F.col("verdict").isNotNull(), _told(5, kind, F.col("verdict")))
        .when(F.col("made"), _told(4, F.lit("generated"), F.lit("family")))
        .when(F.col("mark") != "", _told(3, F.col("mark"), F.lit("mark")))
        .when(F.col("alone") != "", _told(2, F.col("alone"), F.lit("form")))
        .otherwise(_told(1, F.lit("hand"), F.lit(None)))
    )
    per = told.groupBy("path").agg(F.max(best).alias("best"), F.max("mark").alias("mark"))
    by_name = _told(0, F.when(F.col("by_path") == "", "hand").otherwise(F.col("by_path")), F.when(F.col("by_path") != "", "mark"))
    return paths.join(per, "path", "left").withColumn("best", F.coalesce("best", by_name)).select("path", "best.kind", "best.reason", F.coalesce("mark", "by_path").alias("mark"))
