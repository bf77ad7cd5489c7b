"""Command line: python -m twinspan scan|list|show|dismiss|suppressions|diff|clean|config."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinspan.config import ConfigError, edit
from twinspan.engine import Engine, resolve_format
from twinspan.functions.labels import dismissed_label, hex16, unix_date
from twinspan.operators import history
from twinspan.sources.files import Folder
from twinspan.sources.warehouse import NewerStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinspan")
    p.add_argument("--format", choices=("text", "json", "sarif"))
    p.add_argument("--tier", choices=("a", "b", "both"), default="both")
    p.add_argument("--lang", action="append", choices=("rust", "ts", "python"), default=[])
    p.add_argument("--strict", action="store_true", help="exit 1 if anything is found")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--all", action="store_true", help="only the project's own ignore rules hold")
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "list", "clean", "config", "suppressions"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        if name == "clean":
            c.add_argument("-y", "--yes", action="store_true")
        if name == "config":
            c.add_argument("--edit", choices=("global", "project"), help="open the file in $VISUAL or $EDITOR")
        if name == "suppressions":
            c.add_argument("--clear", action="store_true")
    for name in ("show", "dismiss"):
        c = sub.add_parser(name)
        c.add_argument("id", type=int)
        c.add_argument("path", nargs="?", default=".")
        if name == "dismiss":
            c.add_argument("--file")
    c = sub.add_parser("diff")
    c.add_argument("--since", required=True, help="scan id, commit prefix, or now, yesterday, <n>m|h|d|w")
    c.add_argument("path", nargs="?", default=".")
    return p


def print_groups(engine: Engine, args: argparse.Namespace) -> int:
    found = 0
    shown = resolve_format(args.format, sys.stdout.isatty())
    rows = engine.list(shown, args.tier, tuple(args.lang))
    for r in rows.toLocalIterator():  # a report: one group at a time
        found += 1
        if not args.quiet:
            print(r[2])
    return int(args.strict and found > 0)


def clean(engine: Engine, yes: bool) -> int:
    """Drop the store: at once with --yes, after a question on a terminal, never without either."""
    if not Folder(engine.spark, engine.warehouse).exists():
        print(f"twinspan: no store at {engine.warehouse}")
        return 0
    if not yes:
        if not sys.stdin.isatty():
            print(f"twinspan: {engine.warehouse} is left alone; say --yes where nobody can be asked", file=sys.stderr)
            return 2
        if input(f"Drop {engine.warehouse}, history and dismissals included? [y/N] ").strip().lower() not in ("y", "yes"):
            print("left alone")
            return 0
    engine.clean(True)
    print(f"dropped {engine.warehouse}")
    return 0


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine(spark, args.path)
    if args.command == "scan":
        engine.scan(not args.no_gitignore, args.all)
        counts = engine.issues()
        if counts:
            print(f"{sum(counts.values())} issues: " + ", ".join(f"{k} {n}" for k, n in sorted(counts.items())), file=sys.stderr)
        return print_groups(engine, args)
    if args.command == "list":
        return print_groups(engine, args)
    if args.command == "show":
        print(engine.show(args.id, "text" if resolve_format(args.format, sys.stdout.isatty()) == "text" else "json"))
    elif args.command == "dismiss":
        engine.dismiss(args.id, args.file)
    elif args.command == "suppressions":
        if args.clear:
            print(engine.clear_suppressions(), "cleared")
        else:
            print(f"{'HASH':<16}  {'DATE':<12}  LABEL")
            for r in engine.suppressions().select(hex16(F.col("group_hash")).alias("hash"), unix_date(F.col("dismissed_at")).alias("day"), dismissed_label(F.col("group_hash")).alias("label")).toLocalIterator():
                print(f"{r['hash']}  {r['day']:<12}  {r['label']}")
    elif args.command == "diff":
        print("KIND    HASH              COUNTS  DELTA")
        for r in history.diff_text(engine.diff(args.since)).toLocalIterator():
            print(r["line"])
    elif args.command == "clean":
        return clean(engine, args.yes)
    elif args.command == "config":
        if args.edit:
            return edit(engine.root, args.edit == "global")
        print(engine.config_paths())
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 fine, 1 strict and something found, 2 a user's error."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args, spark or SparkSession.builder.appName("twinspan").getOrCreate())
    except (FileNotFoundError, KeyError, ValueError, ConfigError, NewerStore) as e:
        print(f"twinspan: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
