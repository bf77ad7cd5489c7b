"""The joined views on small tables: floors, chips, counts, ties and empty sides."""

from pyspark.sql import functions as F

from twinspan.functions.labels import blob_hash, completion_banner, elapsed, group_label, tier_label
from twinspan.operators import store, views

GROUPS = "id bigint, group_hash bigint, hash_hex string, tier string, occurrence_count bigint, total_lines bigint, total_tokens bigint"
OCC = "id bigint, group_id bigint, path string, start_line int, end_line int, start_byte int, end_byte int, alpha array<struct<s:int,e:int,idx:int>>"


def tables(spark):
    groups = [(1, 11, "0b", "A", 3, 30, 9), (2, 12, "0c", "B", 2, 8, 4), (3, 13, None, "A", None, None, None), (4, -1, "ff", "B", 1, 5, 2)]
    occ = [
        (1, 1, "r/src/a.py", 1, 10, 0, 90, None), (2, 1, "r/src/b.py", 5, 14, 3, 80, []), (3, 1, "q/lib/c.rs", 1, 10, None, None, None), (3, 1, "q/lib/c.rs", 10, 1, None, None, None),
        (4, 2, "r/src/a.py", 20, 23, 0, 9, [(4, 6, 2), (0, 2, 1)]), (5, 2, "r/src/z.py", 1, 4, 0, 9, [(4, 6, 12)]), (6, 4, "r/one.ts", 2, 6, 1, 2, None), (7, 99, "r/lost.ts", 1, 2, 0, 1, None), (8, 1, None, 1, 2, 0, 1, None),
    ]
    g, o = spark.createDataFrame(groups, GROUPS), spark.createDataFrame(occ, OCC)
    return store.groups_view(g), store.occurrences_view(o), o


def test_summary_and_lists(spark):
    g, o, _ = tables(spark)
    summary = store.group_summary(g, o)
    got = {r["id"]: (r["n"], r["lines"], r["files"], r["severity"], r["label"], r["language"]) for r in summary.collect()}
    assert got[1] == (3, 30, 3, 90, "q/lib/c.rs:L1–10", "Rust") and got[3] == (0, 0, 0, 0, "(empty group)", None) and set(got) == {1, 2, 3, 4}
    badges = spark.createDataFrame([(11, "GREW"), (12, "NEW"), (12, "NEW"), (50, "GREW")], "group_hash bigint, kind string")
    rows = lambda *a, **k: {r["id"]: (r["n"], r["ordinal"]) for r in views.composite_list(summary, o, *a, **k).collect()}
    assert rows("severity") == {1: (3, 1), 2: (2, 2), 4: (1, 3), 3: (0, 4)}
    assert rows("severity", "SRC", pattern="/lib/") == {1: (1, 1)} and rows("alphabetical", "typescript") == {4: (1, 1)} and rows("severity", "no such") == {}
    assert set(rows("severity", badges=badges, chip="new")) == {2} and set(rows("severity", badges=badges, chip="grew")) == {1} and rows("severity", badges=badges, chip="gone") == {}
    assert {r["id"]: (r["files"], r["duplicated_lines"]) for r in views.toolbar_counts(summary).collect()} == {1: (3, 20), 2: (2, 4), 3: (0, 0), 4: (1, 0)}
    assert [(r["id"], r["ordinal"]) for r in views.tier_partition(g).orderBy("ordinal").collect()] == [(2, 1), (4, 2), (1, 3), (3, 4)]
    assert {r["group_hash"]: r["id"] for r in views.provisional_views(g).collect()} == {11: -1, 12: -2, 13: -3, -1: -4}


def test_session_floor_spares_groups_without_dismissals(spark):
    g, o, _ = tables(spark)
    rows = g.join(o, g["id"] == o["group_id"]).select("id", "group_hash", "path", "start_line")
    gone = spark.createDataFrame([(12, "r/src/z.py"), (11, "q/lib/c.rs"), (11, "nowhere")], "group_hash bigint, path string")
    assert {r["id"]: r["count"] for r in views.session_floor(rows, gone).groupBy("id").count().collect()} == {1: 2, 4: 1}
    assert views.session_floor(rows, gone.limit(0)).count() == rows.count()


def test_checked_rows_and_reviews(spark):
    g, o, _ = tables(spark)
    checked = spark.createDataFrame([(1, "r/src/b.py", 5), (1, "r/src/b.py", 5), (77, "x", 1)], "group_id bigint, path string, start_line int")
    got = {(r["group_id"], r["path"], r["line"]) for r in views.checked_or_all(o, checked).collect()}
    assert {x for x in got if x[0] == 1} == {(1, "r/src/b.py", 5)} and len([x for x in got if x[0] == 2]) == 2
    dismissed = spark.createDataFrame([(12,), (60,)], "group_hash bigint")
    reviewed = spark.createDataFrame([(60,), (11,), (11,), (1000,)], "group_hash bigint")
    assert tuple(views.review_counts(g, dismissed, reviewed).first()) == (5, 2)


def test_baseline_and_detail(spark):
    pairs = spark.createDataFrame([(7, 2, 1), (8, 3, None)], "folder_hash bigint, head bigint, base bigint")
    rows = spark.createDataFrame([(1, 11, 2), (2, 11, 5), (2, 12, None), (1, 13, 4), (3, 11, 1), (2, 14, 3), (1, 14, 9)], "scan_id bigint, group_hash bigint, occurrence_count bigint")
    seen = spark.createDataFrame([(11, 100), (12, 200)], "group_hash bigint, first_at bigint")
    meta = views.baseline_meta(pairs, rows, seen)
    assert {tuple(r) for r in meta.collect()} == {(7, 11, 100, 2, 5), (7, 12, 200, 0, 0), (8, 11, 100, 0, 1), (7, 14, None, 9, 3)}
    said = {(r["folder_hash"], r["group_hash"]): r["text"] for r in views.detail_summary(meta).collect()}
    assert said[7, 11] == "5 occurrences · 3 new occurrences since baseline" and said[7, 14] == "3 occurrences · 6 occurrences removed since baseline" and said[7, 12] == "0 occurrences"


def test_alpha_spans_are_ordered(spark):
    _, _, o = tables(spark)
    got = {(r["group_id"], r["path"]): [tuple(x) for x in r["spans"]] for r in views.alpha_spans(o).collect()}
    assert got == {(2, "r/src/a.py"): [(0, 2, 1, 0), (4, 6, 2, 1)], (2, "r/src/z.py"): [(4, 6, 12, 1)]}


def test_labels(spark):
    row = spark.range(1).select(
        elapsed(F.lit(59.96)).alias("a"), elapsed(F.lit(61.9)).alias("b"), completion_banner(F.lit(7), F.lit(42), F.lit(3.4)).alias("c"), tier_label(F.lit("b")).alias("d"), tier_label(F.lit(None).cast("string")).alias("e"),
        blob_hash(F.unhex(F.lit("ffffffffffffffff"))).alias("f"), blob_hash(F.unhex(F.lit("ff"))).alias("g"), group_label(F.lit("B"), F.lit("run"), F.lit("fn"), F.lit("p")).alias("h"),
        group_label(F.lit("A"), F.lit("run"), F.lit("fn"), F.lit(None).cast("string")).alias("i"), group_label(F.lit("B"), F.lit("run"), F.lit(None).cast("string"), F.lit("p")).alias("j"),
    ).first()
    assert tuple(row) == ("60.0s", "61s", "Scan complete — 7 groups across 42 files in 3.4s.", "B", "A", -1, None, "fn run", "(empty group)", "run")
