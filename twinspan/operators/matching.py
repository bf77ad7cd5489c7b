"""Maximal repeated runs of token windows, grouped (tier A).

Runs of consecutive repeated windows are the units: a window that occurs once
ends every extension, so runs do not influence each other except through equal
windows. Runs with the same sequence of hashes behave alike and are kept once
with all their places; what remains falls into components of runs that share a
hash. Each component is extended greedily in order of path and position, and
the result is spread to all places again.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.functions.labels import hex16
from twinspan.operators.components import connected_components
from twinspan.operators.lexing import WINDOW, file_id, file_windows, repeated_cells, repeated_hashes
from twinspan.session import cut

MIN_LINES, MIN_TOKENS = 6, 50


def greedy(runs: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """Spans (run, first window, last window, hash) of runs given in visiting order.

    A window not yet covered seeds a span together with all windows of its
    hash, covered or not; they grow while each has a next window in its run
    and all next ones are equal.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    for r, run in enumerate(runs):
        for i, h in enumerate(run):
            places.setdefault(h, []).append((r, i))
    covered = [bytearray(len(run)) for run in runs]
    out = []
    for r, run in enumerate(runs):
        i = 0
        while i < len(run):
            if covered[r][i]:
                i += 1
                continue
            peers = places[run[i]]
            k = 0
            while i + k + 1 < len(run):
                want = run[i + k + 1]
                if not all(at + k + 1 < len(runs[p]) and runs[p][at + k + 1] == want for p, at in peers):
                    break
                k += 1
            for p, at in peers:
                covered[p][at : at + k + 1] = b"\1" * (k + 1)
                out.append((p, at, at + k, run[i]))
            i += k + 1
    return out


def repeated_runs(cells: DataFrame) -> DataFrame:
    """One row per maximal run of consecutive repeated windows of a file."""
    place = Window.partitionBy("fid").orderBy("win")
    island = cells.withColumn("run", F.col("win") - F.row_number().over(place))
    cell = F.struct("win", "h", "start_line", "end_line", "start_byte", "end_byte")
    return island.groupBy("fid", "run").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def match_runs(files: DataFrame) -> DataFrame:
    """``h, length, path, start_line, end_line, start_byte, end_byte`` of every span, from kept rows of :func:`file_windows`."""
    cells = repeated_cells(files, cut(repeated_hashes(files)))
    names = files.select(file_id(), "path").distinct()
    hashes = F.transform("cells", lambda c: c["h"])
    runs = cut(repeated_runs(cells).withColumn("key", F.md5(F.concat_ws(",", F.transform("cells", lambda c: c["h"].cast("string"))))).join(names, "fid"))
    order = F.struct(F.split("path", "/").alias("p"), F.col("cells")[0]["win"].alias("w"))
    first = runs.groupBy("key").agg(F.min(F.struct(order.alias("o"), hashes.alias("hs"))).alias("m")).select("key", "m.o", "m.hs")
    first = cut(first.withColumn("cls", F.xxhash64("key")))
    pairs = first.select("cls", F.explode("hs").alias("h")).distinct()
    root = pairs.groupBy("h").agg(F.min("cls").alias("root"))
    parts = connected_components(pairs.join(root, "h").select("cls", "root"), "cls", "root")
    grouped = first.join(parts, first["cls"] == parts["node"], "left").withColumn("part", F.coalesce("component", "cls")).select("part", "key", "o", "hs")

    def extend(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda x: (list(x.o["p"]), x.o["w"]))
        found = greedy([x.hs.tolist() for x in rows])
        return pd.DataFrame([(rows[r].key, a, b, h) for r, a, b, h in found], columns=["key", "a", "b", "h"])

    spans = grouped.groupBy("part").applyInPandas(extend, "key string, a int, b int, h bigint")
    first_cell, last_cell = F.col("cells")[F.col("a")], F.col("cells")[F.col("b")]
    return spans.join(runs.select("key", "path", "cells"), "key").select(
        "h",
        (F.col("b") - F.col("a") + 1).alias("length"),
        "path",
        first_cell["start_line"].alias("start_line"),
        last_cell["end_line"].alias("end_line"),
        first_cell["start_byte"].alias("start_byte"),
        last_cell["end_byte"].alias("end_byte"),
    )


def tier_a(corpus: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, n: int = WINDOW) -> DataFrame:
    """Occurrences of tier A groups: ``group_hash, tier, length, path, lines, bytes``.

    A group is all spans of a hash and length that reach the thresholds, if
    there are two.
    """
    return tier_a_of(cut(file_windows(corpus, n)), min_lines, min_tokens, n)


def tier_a_of(files: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, n: int = WINDOW) -> DataFrame:
    """As :func:`tier_a`, from window rows that are kept somewhere (read twice), made now or stored by an earlier scan."""
    spans = cut(match_runs(files).filter((F.col("end_line") - F.col("start_line") + 1 >= min_lines) & (F.col("length") + n - 1 >= min_tokens)).distinct())
    kept = spans.groupBy("h", "length").agg(F.count("*").alias("n")).filter("n > 1").select("h", "length")
    return spans.join(kept, ["h", "length"], "left_semi").select(F.col("h").alias("group_hash"), hex16(F.col("h")).alias("hash"), F.lit("A").alias("tier"), "length", "path", "start_line", "end_line", "start_byte", "end_byte")


def promote(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tier A occurrences at the exact lines of a tier B one give way; then the floor of two again."""
    keys = ["path", "start_line", "end_line"]
    left = a.join(b.select(*keys).distinct(), keys, "left_anti")
    kept = left.groupBy("group_hash", "length").agg(F.count("*").alias("n")).filter("n > 1").select("group_hash", "length")
    return left.join(kept, ["group_hash", "length"], "left_semi")


def brute_force(files: Iterable[tuple[str, list[int]]]) -> list[tuple[str, int, int, int]]:
    """The same spans from whole files on one machine, for tests."""
    rows = sorted(files, key=lambda x: x[0].split("/"))
    places: dict[int, list[tuple[int, int]]] = {}
    for f, (_, hs) in enumerate(rows):
        for i, h in enumerate(hs):
            places.setdefault(h, []).append((f, i))
    covered: set[tuple[int, int]] = set()
    out = []
    for f, (_, hs) in enumerate(rows):
        i = 0
        while i < len(hs):
            peers = places[hs[i]]
            if len(peers) < 2 or (f, i) in covered:
                i += 1
                continue
            k = 0
            while i + k + 1 < len(hs) and len(places[hs[i + k + 1]]) > 1 and all(at + k + 1 < len(rows[p][1]) and rows[p][1][at + k + 1] == hs[i + k + 1] for p, at in peers):
                k += 1
            for p, at in peers:
                covered.update((p, at + j) for j in range(k + 1))
                out.append((rows[p][0], at, at + k, hs[i]))
            i += k + 1
    return out
