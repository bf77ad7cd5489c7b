"""The engine's commands on a small tree, the store, configuration, ignore rules."""

import json
import os

import pytest
from pyspark.sql import functions as F

from twinspan import config
from twinspan.engine import Engine, fnv1a, resolve_format
from twinspan.operators.history import parse_relative_date, resolve_baseline, resolve_since
from twinspan.sources.ignore import ignored, ingest_status, rule_regex
from twinspan.sources.tree import read_corpus
from twinspan.sources.warehouse import NewerStore, Warehouse
from twinspan.streaming.incremental import append_fingerprints, fingerprint_stream

BODY = "".join(f"    total_{i} = total_{i} + weigh(rows[{i}], 'x{i}')\n" for i in range(12))
FUNCTION = "def add(rows):\n" + BODY + "    return total_1\n"


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "a.py": "import one\n\n" + FUNCTION,
        "lib/b.py": "import two\nimport three\n\n" + FUNCTION,
        "vendor/c.py": FUNCTION,
        "gen.py": "# @generated\n" + FUNCTION,
        "notes.md": FUNCTION,
        "skip/d.py": FUNCTION,
        ".twinspanignore": "skip/\n",
        "bin.dat": "a\0b",
        "sub/.git/HEAD": "x",
        "sub/e.py": FUNCTION,
    }.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    return tmp_path


def test_commands(spark, tree):
    engine = Engine(spark, str(tree))
    with pytest.raises(FileNotFoundError):
        engine.suppressions()
    assert engine.scan(now=1000) == 1
    rows = engine.list("json").collect()
    groups = [json.loads(r["json"]) for r in rows]
    assert {o["path"] for g in groups for o in g["occurrences"]} == {"a.py", "lib/b.py"}
    assert {g["tier"] for g in groups} == {"A", "B"} or {g["tier"] for g in groups} == {"B"}
    assert [g["ordinal"] for g in groups] == list(range(1, len(groups) + 1))
    assert engine.issues() == {"utf8": 1}
    assert engine.show(1).startswith("--- [") and engine.strict_exit() == 1
    with pytest.raises(KeyError):
        engine.show(999)
    engine.write_list(str(tree / "out.sarif"), "sarif")
    sarif = json.loads((tree / "out.sarif").read_text())
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == len(groups)
    os.remove(tree / "out.sarif")

    for g in groups:
        engine.dismiss(g["id"], now=1500)
    assert engine.list("text").count() == 0 and engine.strict_exit() == 0
    assert engine.suppressions().count() == len({g["hash"] for g in groups})
    assert engine.undismiss(groups[0]["hash"]) == 1 and engine.undismiss(groups[0]["hash"]) == 0
    assert engine.list("text").count() == 1
    engine.dismiss(groups[0]["id"], "a.py", now=1600)
    assert engine.list("text").count() == 0  # one occurrence left is under the floor
    assert engine.undismiss(groups[0]["hash"], "*") == 1
    engine.clear_suppressions()
    assert engine.list("text").count() == len(groups)

    (tree / "lib" / "f.py").write_text("import four\n\n" + FUNCTION)
    assert engine.scan(now=2000) == 2
    assert {r["kind"] for r in engine.diff("1").collect()} <= {"GREW", "NEW", "GONE"} and engine.diff("1").count() > 0
    with pytest.raises(ValueError):
        engine.diff("2")
    assert engine.clean() is False and engine.clean(True) is True and not os.path.exists(tree / ".twinspan")


def test_hidden_and_underscored_files_are_read(spark, tmp_path):
    names = {"pkg/__init__.py", "pkg/_util.py", "pkg/a.py", "_private/b.py", ".hid/c.py", ".eslintrc.js", "odd name%20.py", ".gitignore"}
    for name in (*names, ".git/config", "out/d.py", "vendor/_e.py", "w/part.py"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text("out/\n" if name == ".gitignore" else f"x = '{name}'\n")
    os.symlink(tmp_path, tmp_path / "pkg" / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "pkg" / "gone.py")
    (tmp_path / "_bad.py").write_bytes(b"x = '\xff\xfe'\n")
    corpus, issues = read_corpus(spark, str(tmp_path), skip=("w",))
    rows = {r["path"]: r for r in corpus.collect()}
    assert set(rows) == names and rows["pkg/_util.py"]["text"] == "x = 'pkg/_util.py'\n" and rows["pkg/a.py"]["length"] == 15
    assert rows["pkg/a.py"]["mtime"] == int(os.stat(tmp_path / "pkg/a.py").st_mtime)
    assert {(r["path"], r["kind"]) for r in issues.collect()} == {("_bad.py", "utf8")}
    everything, _ = read_corpus(spark, str(tmp_path), everything=True, skip=("w",))
    assert {r["path"] for r in everything.collect()} == names | {"out/d.py", "vendor/_e.py"}
    os.makedirs(tmp_path / "empty")
    assert read_corpus(spark, str(tmp_path / "empty"))[0].count() == 0


def test_nested_git_rules(tmp_path):
    from twinspan.sources.tree import walk

    for name, text in {
        ".gitignore": "/out/\n*.gen.py\nlib/*\n!lib/b.py\n",
        ".git/info/exclude": "local.py\n",
        "a/.gitignore": "skip.py\n/here\n!x.gen.py\n",
        "out/.gitignore": "!c.py\n",
        **dict.fromkeys(("local.py", "x.gen.py", "skip.py", "a/skip.py", "a/d/skip.py", "a/here/e.py", "a/d/here/e.py", "a/x.gen.py", "out/c.py", "a/out/c.py", "lib/a.py", "lib/b.py"), "x"),
    }.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {os.fsdecode(r[0]) for r in walk(str(tmp_path), True)}
    assert got == {".gitignore", "a/.gitignore", "skip.py", "a/d/here/e.py", "a/x.gen.py", "a/out/c.py", "lib/b.py"}
    assert len(list(walk(str(tmp_path)))) == 15


def test_files_lost_after_listing_are_issues(spark, tmp_path):
    from twinspan.sources.tree import list_files, with_content

    (tmp_path / "_a.py").write_text("x = 1")
    listed = list_files(spark, str(tmp_path))
    os.remove(tmp_path / "_a.py")
    assert [(r["path"], r["content"], bool(r["error"])) for r in with_content(listed, str(tmp_path)).collect()] == [("_a.py", None, True)]


def test_a_warm_scan_reads_changed_files_only(spark, tree):
    engine, told, pulses = Engine(spark, str(tree)), [], []
    (tree / "deep" / "x").mkdir(parents=True)
    (tree / "deep" / "x" / "h.py").write_text("import six\n\n" + FUNCTION)
    engine.scan(now=1000, progress=lambda *x: told.append(x), pulse=lambda df: pulses.append(df.count()))
    view = lambda: (sorted(r["text"].split("\n", 1)[1] for r in engine.list("text").collect()), engine.issues())
    first, listed = view(), dict(told)["listed"]
    assert len(pulses) == 1 and pulses[0] > 0 and dict(told)["read"] == listed
    told.clear()
    engine.scan(now=1100, progress=lambda *x: told.append(x))
    assert dict(told)["read"] == 0 and view() == first  # bad.py is unread too, its issue is kept
    told.clear()
    (tree / "a.py").write_text("import one, more\n\n" + FUNCTION)
    os.remove(tree / "lib" / "b.py")
    engine.scan(now=1200, progress=lambda *x: told.append(x))
    assert dict(told)["read"] == 1 and dict(told)["listed"] == listed - 1
    warm = view()
    engine.clean(True)
    engine.scan(now=1300)
    assert view() == warm


def test_rules_from_outside_and_links(tmp_path, monkeypatch):
    from twinspan.sources.tree import walk

    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", os.devnull)
    for name, text in {"home/git/ignore": "*.tmp\n", ".gitignore": "top.py\n/r/only.py\n", "r/.gitignore": "!keep.tmp\n", "r/a.tmp": "", "r/keep.tmp": "", "r/top.py": "", "r/only.py": "", "r/s/only.py": "", "r/m/.git/HEAD": "", "r/m/x.py": ""}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "r" / "s", tmp_path / "r" / "link")
    os.symlink(tmp_path / "r" / "s" / "only.py", tmp_path / "r" / "one.py")
    names = lambda **more: {os.fsdecode(r[0]) for r in walk(str(tmp_path / "r"), True, **more)}
    assert names() == {".gitignore", "keep.tmp", "s/only.py", "m/x.py"}
    assert names(follow=True, submodules=False) == {".gitignore", "keep.tmp", "s/only.py", "link/only.py", "one.py"}


def test_old_stores_are_migrated_and_writers_wait(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "_state.json").write_text(json.dumps({"version": 1, "tables": {"suppressions": []}}))
    wh = Warehouse(spark, str(root))
    state = wh.state()
    assert state["schema_version"] == 5 and set(state["tables"]) >= {"suppressions", "file_state", "occurrence_suppressions", "scan_groups"}
    assert Warehouse.open_readonly(spark, str(root)).read("file_units").count() == 0
    with wh.lock():
        with wh.lock():
            assert (root / "_lock").exists()
        with pytest.raises(TimeoutError):
            with Warehouse(spark, str(root)).folder.lock(wait=0.1):
                pass
    assert not (root / "_lock").exists()
    (root / "_lock").write_text("1.0")
    with wh.lock():  # of a writer long dead
        pass


def test_blame(tmp_path):
    from twinspan.sources.git import Blame, blame, commit_of, main_commit, parse_blame

    raw = "0123456789abcdef0123456789abcdef01234567 3 3 1\nauthor A B\nauthor-time 86400\nsummary first words\nfilename x\n\tauthor nobody\n"
    assert parse_blame(raw) == Blame("A B", "01234567", "1970-01-02", "first words")
    assert parse_blame("") is None and parse_blame("zz 1 1") is None and parse_blame("0123456789 1 1\n\tx") == Blame("?", "01234567", "?", "")
    assert blame(str(tmp_path), "none.py", 1) is None and main_commit(str(tmp_path)) is None and commit_of(str(tmp_path / "no")) is None


def test_config_edit(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "g"))
    for name in ("VISUAL", "EDITOR"):
        monkeypatch.delenv(name, raising=False)
    assert config.edit(str(tmp_path)) == 2
    monkeypatch.setenv("EDITOR", "true --")
    assert config.edit(str(tmp_path)) == 0 and "schema_version" in (tmp_path / config.PROJECT_FILE).read_text()


def test_store_swaps_and_refuses_newer(spark, tmp_path):
    root = str(tmp_path / "w")
    wh = Warehouse(spark, root)
    rows = spark.createDataFrame([(1, 5, None)], "group_hash bigint, dismissed_at bigint, last_group_id bigint")
    wh.commit({"suppressions": rows}, {"scan_groups": spark.createDataFrame([(1, 2, 3, 4)], "scan_id bigint, group_hash bigint, occurrence_count bigint, total_lines bigint")})
    wh.commit({"suppressions": wh.read("suppressions").unionByName(rows.withColumn("group_hash", F.lit(2).cast("bigint")))}, {"scan_groups": wh.read("scan_groups").withColumn("scan_id", F.lit(2).cast("bigint"))})
    assert wh.read("suppressions").count() == 2 and wh.read("scan_groups").count() == 2 and wh.read("issues").count() == 0
    assert Warehouse.open_readonly(spark, str(tmp_path / "none")) is None
    state = json.loads((tmp_path / "w" / "_state.json").read_text())
    (tmp_path / "w" / "_state.json").write_text(json.dumps(state | {"schema_version": 99}))
    with pytest.raises(NewerStore):
        Warehouse(spark, root)


def test_config_layers(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "g"))
    os.makedirs(tmp_path / "g" / "twinspan")
    (tmp_path / "g" / "twinspan" / "config.toml").write_text("normalization = 'aggressive'\n[thresholds.tier_a]\nmin_lines = 9\n")
    (tmp_path / config.PROJECT_FILE).write_text("schema_version = 1\n[thresholds.tier_a]\nmin_lines = 7\n")
    got = config.load(str(tmp_path))
    assert (got.tier_a_min_lines, got.tier_a_min_tokens, got.normalization) == (7, 50, "aggressive")
    for text, error in [("x = 1", config.ConfigError), ("schema_version = 2", config.NewerSchema), ("normalization = 'odd'", config.ConfigError), ("[scan]\nmax_file_size = 'a'", config.ConfigError), ("[", config.ConfigError)]:
        with pytest.raises(error):
            config.overlay(config.Config(), text)


def test_ignore_rules(spark):
    assert rule_regex("# x") is None and rule_regex("  ") is None
    paths = ["a/x.min.js", "vendor/a.py", "src/vendors/a.py", "keep.md", "deep/b.log", "src/gen/x.rs", "Cargo.lock", "src/a.rs", "logs", "a/logs/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0] for r in df.filter(ignored(F.col("p"), ("!keep.md", "src/**/x.rs", "/logs"))).collect()}
    assert got == {"a/x.min.js", "vendor/a.py", "deep/b.log", "src/gen/x.rs", "Cargo.lock", "logs"}
    rows = [("a/.git/x", "t", 1), ("a.py", "x\0", 2), ("b.py", "1\n2\n3\n4\n// @generated", 9), ("c.py", "1\n2\n3\n4\n5\n// @generated", 9), ("d.py", "x", 1 << 21)]
    status = spark.createDataFrame(rows, "p string, t string, n bigint").select("p", ingest_status(F.col("p"), F.col("t"), F.col("n")))
    assert dict(map(tuple, status.collect())) == {"a/.git/x": "git_dir", "a.py": "binary", "b.py": "generated", "c.py": "ok", "d.py": "too_large"}


def test_references_to_scans(spark):
    scans = spark.createDataFrame([(1, 100, 7, "abcdef12"), (2, 200, 7, "ABCD9999"), (3, 900000, 7, None)], "scan_id bigint, started_at bigint, folder_hash bigint, git_commit string")
    assert resolve_since(scans, "2", 0) == 2 and resolve_since(scans, "abcd", 0) == 2 and resolve_since(scans, "abcde", 0) == 1
    assert resolve_since(scans, "1h", 3800) == 2 and resolve_since(scans, "abc", 0) is None and resolve_since(scans, "99", 0) is None
    assert parse_relative_date("yesterday", 90000) == 3600 and parse_relative_date("2w", 0) == -1209600 and parse_relative_date("2y", 0) is None
    assert resolve_baseline(scans, "last_scan") == 2 and resolve_baseline(scans, "last_week", 604800 + 150) == 1
    assert resolve_baseline(scans, "main_commit", commit="abcdef12") == 1 and resolve_baseline(scans, "pick", scan_id=3) is None


def test_small_functions():
    assert fnv1a(b"") == 0xCBF29CE484222325 - (1 << 64) and resolve_format(None, True) == "text" and resolve_format(None, False) == "json" and resolve_format("sarif", True) == "sarif"


def test_fingerprint_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a.py", FUNCTION), ("vendor/b.py", FUNCTION), (None, "x")], "path string, text string").write.parquet(source)
    append_fingerprints(fingerprint_stream(spark, source), out, state).awaitTermination(120)
    once = spark.read.parquet(out).count()
    spark.createDataFrame([("c.py", FUNCTION)], "path string, text string").write.mode("append").parquet(source)
    append_fingerprints(fingerprint_stream(spark, source), out, state).awaitTermination(120)
    assert once > 0 and spark.read.parquet(out).count() == 2 * once


def test_command_line(spark, tree, capsys):
    from twinspan.__main__ import main

    assert main(["--strict", "--format", "text", "scan", str(tree)], spark) == 1
    said = capsys.readouterr()
    assert "a.py:" in said.out and "1 issues: utf8 1" in said.err
    assert main(["--format", "json", "--lang", "rust", "--tier", "b", "list", str(tree)], spark) == 0 and capsys.readouterr().out == ""
    assert main(["show", "1", str(tree)], spark) == 0 and main(["show", "77", str(tree)], spark) == 2
    assert main(["dismiss", "1", str(tree)], spark) == 0 and main(["suppressions", str(tree)], spark) == 0
    assert main(["diff", "--since", "never", str(tree)], spark) == 2 and main(["list", str(tree / "lib")], spark) == 2
    before = Engine(spark, str(tree))._open().read("file_blocks").orderBy("path").collect()
    assert main(["-q", "scan", str(tree)], spark) == 0  # stored fingerprints are taken over
    assert Engine(spark, str(tree))._open().read("file_blocks").orderBy("path").collect() == before
    assert main(["clean", str(tree)], spark) == 2 and main(["clean", "-y", str(tree)], spark) == 0 and main(["nonsense"], spark) == 2
