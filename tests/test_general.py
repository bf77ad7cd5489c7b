"""Intervals, snapshots, components, ordinals against brute force."""

import random

from pyspark.sql import functions as F

from twinspan.functions.paths import canonical_path
from twinspan.operators.components import connected_components
from twinspan.operators.intervals import merge_intervals
from twinspan.operators.ranking import with_ordinal
from twinspan.operators.snapshots import snapshot_diff


def brute_intervals(rows):
    by = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None:
            by.setdefault(k, set()).update(range(min(a, b), max(a, b) + 1))
    out = set()
    for k, lines in by.items():
        inside, start = True, min(lines)
        for x in range(min(lines), max(lines) + 2):
            if inside != (x in lines):
                out.add((k, "period" if inside else "gap", start, x - 1))
                inside, start = not inside, x
    return out


def test_intervals_random_and_dirty(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randint(-50, 400), 0) for _ in range(300)]
    rows = [(k, a, a + rng.randint(-9, 9)) for k, a, _ in rows] + [(None, 1, 2), ("a", None, 3), ("b", 4, None), ("n", None, None)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "path string, s int, e int")
    for bits in (2, 4, 16):  # blocks small enough to cut every key
        got = {tuple(r) for r in merge_intervals(df, "path", "s", "e", bits).collect()}
        assert got == brute_intervals(rows)


def test_intervals_empty_clashing_and_extreme(spark):
    assert merge_intervals(spark.createDataFrame([], "path string, s int, e int"), "path", "s", "e").count() == 0
    df = spark.createDataFrame([("x", 1, 2, 7, 8), ("x", 3, 4, 7, 8), ("x", 2147483647, 2147483647, 0, 0)], "k string, lo int, hi int, p int, d int")
    got = sorted(map(tuple, merge_intervals(df, "k", "lo", "hi").collect()))
    assert got == [("x", "gap", 5, 2147483646), ("x", "period", 1, 4), ("x", "period", 2147483647, 2147483647)]


def brute_snapshots(scans, rows):
    known = {}
    for s, at, folder in scans:
        if s is not None:
            known[s] = max(known.get(s, (at, folder)), (at, folder))
    held = {}
    for s, g, c, n, v in rows:
        if s in known and g is not None:
            held.setdefault(s, {}).setdefault(g, []).append((v, c, n))
    folders = {}
    for s in held:
        folders.setdefault(known[s][1], []).append((known[s][0], s))
    out = set()
    for snaps in folders.values():
        order = [s for _, s in sorted(snaps)]
        for a, b in zip(order, order[1:], strict=False):
            old = {g: max(v)[1:] for g, v in held[a].items()}
            new = {g: max(v)[1:] for g, v in held[b].items()}
            out |= {(b, g, "added") for g in new.keys() - old.keys()} | {(b, g, "removed") for g in old.keys() - new.keys()}
            out |= {(b, g, "changed") for g in new.keys() & old.keys() if new[g] != old[g]}
    return out


def test_snapshots_random(spark):
    rng = random.Random(2)
    scans = [(i, rng.randint(0, 40) * 86400 * 5, rng.choice([1, 1, 1, 2])) for i in range(40)]
    rows = [(rng.randint(-2, 45), rng.randint(0, 8), rng.randint(1, 3), rng.randint(1, 2), rng.randint(0, 3)) for _ in range(500)]
    sdf = spark.createDataFrame(scans + scans[:5], "scan_id bigint, started_at bigint, folder_hash bigint")
    rdf = spark.createDataFrame(rows + rows[:50], "scan_id bigint, group_hash bigint, occurrence_count bigint, total_lines bigint, ingested_at bigint")
    for block in (86400, 30 * 86400):
        pairs = {tuple(r) for r in snapshot_diff(sdf, rdf).collect()}
        assert pairs == brute_snapshots(scans, rows), block


def test_snapshots_nulls_and_empty(spark):
    s = "scan_id bigint, started_at bigint, folder_hash bigint"
    r = "scan_id bigint, group_hash bigint, occurrence_count bigint, total_lines bigint, ingested_at bigint, k int, sign int"
    scans = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 15, None)], s)
    rows = spark.createDataFrame([(1, 5, None, 1, 1, 0, 0), (2, 5, None, 1, 1, 0, 0), (1, 6, None, 1, 1, 0, 0), (2, 6, 0, 1, 1, 0, 0), (1, None, 1, 1, 1, 0, 0), (9, 5, 1, 1, 1, 0, 0)], r)
    assert [tuple(x) for x in snapshot_diff(scans, rows).collect()] == [(2, 6, "changed")]
    assert snapshot_diff(spark.createDataFrame([], s), rows).count() == 0
    assert snapshot_diff(scans, spark.createDataFrame([], r)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    want = {x: find(x) for x in list(parent)}
    groups = {}
    for x, root in want.items():
        groups.setdefault(root, []).append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_ordinals(spark):
    rows = [(i, (i * 7919) % 101) for i in range(1000)]
    got = with_ordinal(spark.createDataFrame(rows, "id int, v int").repartition(7), [-F.col("v"), F.col("id")]).select("id", "ordinal").collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {r["id"]: r["ordinal"] for r in got} == want


def test_canonical_paths(spark):
    cases = {
        "a/b.rs": "a/b.rs", "./a//b.rs": "a/b.rs", ".\\a\\b.rs": "a/b.rs", "/srv/checkout/a/./b.rs": "a/b.rs", "a/.git/x": "a/.git/x", "/srv//checkout/a/": "a",
        "srv/checkout/a": "srv/checkout/a", "/srv/checkouts/a": "srv/checkouts/a", "": "", "./.": "", "/": "", "a/..b/.c": "a/..b/.c",
    }
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert [tuple(r) for r in df.select("p", "want", canonical_path(F.col("p")).alias("got")).filter("want <> got").collect()] == []
    assert spark.createDataFrame([(None,)], "p string").select(canonical_path(F.col("p"))).first()[0] is None
