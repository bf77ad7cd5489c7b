"""Origins of files by path, head, form and copies."""

import random
import re

import numpy as np

from twinspan.llm.origin import code_of, dense_share, form_kind, head_kind
from twinspan.llm.vendoring import PAIRWISE, bucket_links, file_origins


def hand(seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    return "".join(f"def {name()}({name()}):\n    if {name()} > {rng.randint(1, 9999)}:\n        return '{name()}'\n    return {name()}({rng.randint(1, 99)})\n\n" for _ in range(8))


def kinds(spark, files, named=None):
    docs = spark.createDataFrame(files, "path string, text string, kind int") if files else spark.createDataFrame([], "path string, text string, kind int")
    paths = spark.createDataFrame([(p,) for p in (named if named is not None else [f[0] for f in files])], "path string")
    return {r["path"]: (r["kind"], r["reason"]) for r in file_origins(paths, docs).collect()}


def test_heads_only_count_before_code():
    assert head_kind("// Code generated by x. DO NOT EDIT.\nfn f() {}", "rs") == "generated"
    assert head_kind("#!/usr/bin/env python3\n# Bundled copy of left (1.2). Report upstream, not here.\nx = 1", "py") == "vendored"
    assert head_kind("fn f() { s.contains(\"DO NOT EDIT\") }\n// @generated", "rs") == ""
    assert head_kind("# Looks for auto-generated headers in the tree.\nx = 1", "py") == ""
    assert head_kind("// Copyright the own-repo authors; see root.\nlet x;", "ts") == "ours"


def test_forms_of_single_files():
    table = "".join(f"export const field_{i} = 0x{i * 7919:08x};\n" for i in range(20))
    assert form_kind(table, "ts") == "generated"
    blob = "DATA = bytes([\n" + "".join("    " + "0x3f, " * 12 + "\n" for _ in range(10)) + "])\n"
    assert form_kind(blob, "py") == "blob"
    packed = 'X = (\n' + "".join(f'    "{"aB3+" * 18}"\n' for _ in range(8)) + ")\n"
    assert form_kind(packed, "py") == "blob"
    assert form_kind("[\n" + "1.25, 7, -3,\n" * 30 + "8]", "json") == "blob" and form_kind('{"a": 1,\n"b": [2]}', "json") == ""
    dense = "!function(e,t){" + "".join(f"var a{i}=e[{i}]||t({i});" for i in range(60)) + "}(this);"
    assert dense_share(dense) > 0.5 and dense_share(hand(1)) == 0
    assert form_kind(hand(1), "py") == "" and form_kind("", "py") == ""
    assert form_kind('X = "' + "long words of prose " * 40 + '"\n', "py") == ""


def renamed(text):
    return re.sub(r"(?<!')\b[a-j]{7}\b", lambda m: m.group()[::-1].upper(), text)


def test_copies_families_and_paths(spark):
    lib, own, near = hand(2), hand(3), hand(4)
    changed = near.replace("return", "return  ", 1) + "\nEXTRA = 1\n"
    rows = lambda name, n, seed: "".join(f"{name}_{i} = field(0x{i * seed:06x}, \"{name}\")\n" for i in range(n))
    files = [
        ("r/vendor/lib/a.py", lib, 0), ("q/src/a.py", "# note\n" + lib, 0), ("q/src/named.py", renamed(lib), 0), ("r/src/own.py", own, 0), ("q/src/own.py", own, 0), ("r/third_party/n.py", near, 0), ("q/near.py", changed, 0),
        ("r/one.py", rows("B", 30, 77), 0), ("r/two.py", rows("CC", 12, 991), 0), ("q/three.py", rows("DD", 9, 31), 0), ("r/x.min.js", "a()", 0), ("r/empty.py", "", 0), ("r/null.py", None, 0), ("r/dup.py", own, 0), ("r/dup.py", own, 0),
        ("r/num.json", "[" + "12.5, 7,\n" * 40 + "1]", 0), ("q/num.json", "[" + "3.25, 9,\n" * 50 + "2]", 0), ("r/vendor/tiny.js", "go('there')", 0), ("q/tiny.js", "go('there')", 0), ("q/other.js", "go('away')", 0),
    ]
    got = kinds(spark, files, [f[0] for f in files] + ["r/dist/no_text.js", "z/plain.rs", None, "", "r/vendor/lib/a.py"])
    assert {got[p] for p in ("r/vendor/lib/a.py", "q/src/a.py", "q/src/named.py", "r/third_party/n.py", "q/near.py", "r/vendor/tiny.js", "q/tiny.js")} == {("vendored", "copies")}
    assert got["r/src/own.py"][0] == got["q/src/own.py"][0] == got["r/dup.py"][0] == got["q/other.js"][0] == "hand"
    assert got["r/one.py"] == got["r/two.py"] == got["q/three.py"] == ("generated", "family")
    assert got["r/num.json"] == got["q/num.json"] == ("blob", "literals")
    assert got["r/x.min.js"] == ("minified", "mark") and got["r/dist/no_text.js"] == ("generated", "mark") and got["z/plain.rs"] == ("hand", None)
    assert got["r/empty.py"][0] == got["r/null.py"][0] == "hand" and None not in got and "" not in got
    assert kinds(spark, [], []) == {} and kinds(spark, [], ["a/vendor/b.js"]) == {"a/vendor/b.js": ("vendored", "mark")}


def test_buckets_larger_than_pairs_allow_lose_no_group(spark):
    """Three groups in one bucket, one of a third of all nodes: the links join each group and nothing else."""
    n = 40 * PAIRWISE
    group = lambda x: 0 if x % 3 == 0 else 1 + x % 5
    keyed = spark.createDataFrame([(7, x) for x in range(n)] + [(x + 100, x) for x in range(n)], "key bigint, node bigint")
    calls = []

    def verify(pairs):
        calls.append(pairs.count())
        rows = pairs.toPandas()
        return spark.createDataFrame(rows[[group(a) == group(b) for a, b in zip(rows.a, rows.b)]].astype("int64"), "a bigint, b bigint") if len(rows) else pairs

    links = bucket_links(keyed, verify).toPandas()
    head = np.arange(n)
    for _ in range(20):
        for a, b in zip(links.a, links.b):
            head[a] = head[b] = min(head[a], head[b])
    assert {head[x] for x in range(n)} == {min(y for y in range(n) if group(y) == g) for g in {group(x) for x in range(n)}}
    assert sum(calls) < 30 * n


def joined(links, n):
    head = list(range(n))
    for _ in range(n):
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    return head


def test_a_link_to_a_node_that_is_done_is_found(spark, monkeypatch):
    """Nodes on a line, linked up to a distance of 0.2: what joins a chain are links of nodes that no leader is linked with."""
    rng = random.Random(5)
    chains = [0.11 * x for x in range(40)] + [6 + 0.19 * x for x in range(20)] + [20 + rng.random() * 12 for _ in range(60)]
    spots = rng.sample(chains, len(chains))
    n = len(spots)
    keyed = spark.createDataFrame([(7, x) for x in range(n)] + [(8, x) for x in range(0, n, 2)] + [(9, x) for x in range(5)], "key bigint, node bigint")

    def verify(pairs):
        rows = [(r.a, r.b, abs(spots[r.a] - spots[r.b])) for r in pairs.collect()]
        return spark.createDataFrame([(a, b, d <= 0.2, 1 - d) for a, b, d in rows if d <= 0.4], "a bigint, b bigint, linked boolean, like double").selectExpr("*", "CAST(NULL AS double) AS told")

    exact = joined([(a, b) for a in range(n) for b in range(n) if abs(spots[a] - spots[b]) <= 0.2], n)
    for at_once in (10**6, 0):  # in one round, and in rounds of shares
        monkeypatch.setattr("twinspan.llm.vendoring.AT_ONCE", at_once)
        links = [(r.a, r.b) for r in bucket_links(keyed, verify).collect()]
        assert all(abs(spots[a] - spots[b]) <= 0.2 for a, b in links) and joined(links, n) == exact


def test_a_copy_linked_to_one_of_a_large_bucket_only(spark):
    """300 files with a line more than ``base`` fill its buckets; ``near`` is a copy of ``base``, not of them, and shares no other bucket."""
    line = lambda i: f"x = call('value {i}')\n"
    base = [line(i) for i in range(91)]
    near = [line(1000 + i) if i % 9 == 1 else x for i, x in enumerate(base)]
    files = [(f"q{i}/src/a.py", "".join([*base, line(2000 + i)]), 0) for i in range(300)]
    files += [("r/vendor/lib/a.py", "".join([*base, line(3000)]), 0), ("p/src/base.py", "".join(base), 0), ("p/src/near.py", "".join(near), 0)]
    assert set(kinds(spark, files).values()) == {("vendored", "copies")}


def test_comments_are_not_code():
    assert code_of('x = "# no" # yes\n', "py").strip() == 'x = "# no"'
    assert code_of("a(); // b\n/* c */ d('//e');", "js").split() == ["a();", "d('//e');"]


def test_generation_spreads_over_clusters_of_a_repository(spark):
    made, other = hand(21), hand(22)
    near = made.replace("\n\n", "\n    # note\n\n", 1) + "x = 1\n"
    files = [
        ("r1/out/a.py", "# Code generated by tool. DO NOT EDIT.\n" + made, 1),
        ("r1/src/exact.py", made, 1),
        ("r1/src/near.py", near, 1),
        ("r1/src/hand.py", other, 1),
        ("r2/src/sister.py", made, 1),
        ("r2/src/near.py", near, 1),
    ]
    got = kinds(spark, files)
    assert got["r1/out/a.py"] == got["r1/src/exact.py"] == got["r1/src/near.py"] == ("generated", "family")
    assert got["r1/src/hand.py"] == got["r2/src/sister.py"] == got["r2/src/near.py"] == ("hand", None)
