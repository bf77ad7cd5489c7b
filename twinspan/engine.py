"""The engine's commands: scan, list, show, dismiss, suppressions, diff, clean."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan import config as settings
from twinspan.functions.labels import hex16, unhex16
from twinspan.operators import analytics, history, matching, report, store, suppress
from twinspan.operators.lexing import WINDOW, file_windows
from twinspan.operators.ranking import with_ordinal
from twinspan.operators.units import extract_units, tier_b_of
from twinspan.session import cut
from twinspan.sources.tree import candidates, classified, status_issues
from twinspan.sources.files import Folder
from twinspan.sources.git import commit_of
from twinspan.sources.warehouse import Warehouse

_MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a as a signed bit pattern."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h - (1 << 64) if h >> 63 else h


def resolve_format(requested: str | None, terminal: bool) -> str:
    return requested or ("text" if terminal else "json")


class Engine:
    def __init__(self, spark: SparkSession, root: str, warehouse: str | None = None, config: settings.Config | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.config = config or settings.load(self.root)
        self.warehouse = warehouse or os.path.join(self.root, ".twinspan")
        self.job_group = f"twinspan-{uuid.uuid4().hex}"

    def _open(self) -> Warehouse:
        found = Warehouse.open_readonly(self.spark, self.warehouse)
        if found is None:
            raise FileNotFoundError(f"no scan of {self.root} yet")
        return found

    # -- scan

    def find(self, windows: DataFrame, units: DataFrame, pulse: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
        """Occurrences of all groups from the windows and units of files, and issues.

        ``pulse`` is called once with the tier A occurrences, in no order,
        when they are final and before tier B is looked at.
        """
        c = self.config
        a = matching.tier_a_of(windows, c.tier_a_min_lines, c.tier_a_min_tokens)
        if pulse:
            a = cut(a)
            pulse(a)
        b, issues = tier_b_of(units, c.tier_b_min_lines, c.tier_b_min_tokens)
        b = cut(b)
        columns = ["group_hash", "tier", "part", "path", "start_line", "end_line", "start_byte", "end_byte", "alpha"]
        a = matching.promote(a, b).withColumn("part", F.col("length").cast("string")).withColumn("alpha", F.array().cast("array<struct<s:int,e:int,idx:int>>"))
        return a.select(*columns).unionByName(b.select(*columns)), issues

    def scan(
        self,
        gitignore: bool = True,
        everything: bool = False,
        now: int | None = None,
        pulse: Callable[[DataFrame], None] | None = None,
        progress: Callable[[str, int], None] | None = None,
    ) -> int:
        """Scan the tree, replace the current groups, append to the history; the new scan's id.

        Files whose path, size and time are those of the last scan are not
        read again: their windows, units and issues are taken from the store.
        Where no file has changed, come or gone, nor a threshold, the groups
        stay as they are and only the history grows.
        ``progress`` hears of the files listed and read and of the groups
        found. All jobs run in the group that :meth:`cancel` ends; a cancelled
        scan leaves the store as it was.
        """
        told = progress or (lambda stage, count: None)
        c = self.config
        own = (".twinspan", os.path.relpath(self.warehouse, self.root).replace(os.sep, "/"))
        wh = Warehouse(self.spark, self.warehouse)
        with wh.lock(), self._grouped():
            listed = cut(candidates(self.spark, self.root, gitignore, everything, c.include_submodules, c.max_file_size, skip=own, follow=c.follow_symlinks))
            told("listed", listed.count())
            profile = f"{WINDOW} {c.normalization} {everything}"
            same = ["path", "length", "mtime"]
            state = wh.read("file_state").filter((F.col("profile") == profile) & (F.col("status") != "read_error"))
            known = cut(state.join(listed.filter("error IS NULL").select(*same), same, "left_semi"))
            fresh = cut(classified(listed.join(known.select(*same), same, "left_anti"), self.root, everything))
            corpus = fresh.filter("status = 'ok'").select("path", "text")
            read = fresh.count()
            told("read", read)
            settings = f"{profile} {c.tier_a_min_lines} {c.tier_a_min_tokens} {c.tier_b_min_lines} {c.tier_b_min_tokens}"
            scan_id = (wh.read("scans").agg(F.max("scan_id")).first()[0] or 0) + 1
            started = int(time.time()) if now is None else now
            row = self.spark.createDataFrame([(scan_id, started, fnv1a(self.root.encode()), commit_of(self.root))], "scan_id bigint, started_at bigint, folder_hash bigint, git_commit string")

            def snapshot(groups: DataFrame) -> DataFrame:
                return groups.groupBy("group_hash").agg(F.sum("occurrence_count").alias("occurrence_count"), F.sum("total_lines").alias("total_lines")).withColumn("scan_id", F.lit(scan_id))

            if read == 0 and wh.state().get("settings") == settings and wh.read("file_state").count() == known.count():
                groups = wh.read("match_groups")
                told("groups", groups.count())
                if pulse:
                    pulse(wh.read("occurrences").join(groups.filter("tier = 'A'").select(F.col("id").alias("group_id"), "group_hash"), "group_id"))
                wh.commit({}, {"scans": row, "scan_groups": snapshot(groups)})
                return scan_id
            old = known.filter("status = 'ok'").select("path")
            windows = cut(file_windows(corpus).unionByName(wh.read("file_windows").join(old, "path", "left_semi")))
            units = cut(extract_units(corpus, c.normalization).unionByName(wh.read("file_units").join(old, "path", "left_semi")))
            found, more = self.find(windows, units, pulse)
            found = cut(found)
            keys = ["group_hash", "tier", "part"]
            first = F.min(F.struct(F.split("path", "/").alias("p"), "start_line")).alias("first")
            totals = found.groupBy(*keys).agg(
                first, F.count("*").alias("occurrence_count"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("total_tokens")
            )
            groups = cut(with_ordinal(totals, [F.col("tier"), F.col("first"), hex16(F.col("group_hash")), F.col("part")], "id"))
            told("groups", groups.count())
            occ = with_ordinal(found.join(groups.select("id", *keys), keys).withColumnRenamed("id", "group_id"), [F.col("group_id"), F.split("path", "/"), F.col("start_line"), F.col("start_byte")], "id")
            states = cut(fresh.withColumn("content_hash", F.xxhash64("text")).withColumn("profile", F.lit(profile)).drop("text").unionByName(known))
            prints = states.filter("status = 'ok'").select("path", "content_hash", F.col("length").alias("size"), "mtime").join(windows.select("path", F.col("hs").alias("block_hashes")), "path", "left")
            wh.commit(
                {
                    "match_groups": groups.withColumn("hash_hex", hex16(F.col("group_hash"))), "occurrences": occ, "issues": status_issues(states).unionByName(more),
                    "file_blocks": prints, "file_state": states, "file_windows": windows, "file_units": units,
                },
                {"scans": row, "scan_groups": snapshot(groups)},
                settings,
            )
        return scan_id

    @contextmanager
    def _grouped(self) -> Iterator[None]:
        context = self.spark.sparkContext
        context.setJobGroup(self.job_group, f"scan of {self.root}", True)
        try:
            yield
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)

    def cancel(self) -> None:
        """End the running scan at the next task boundary, from another thread."""
        self.spark.sparkContext.cancelJobGroup(self.job_group)

    # -- reads

    def details(self, tier: str = "both", languages: tuple[str, ...] = ()) -> DataFrame:
        """Visible groups with their occurrences: dismissals out, floor of two, tier and language."""
        wh = self._open()
        groups = suppress.without_suppressed_groups(wh.read("match_groups"), wh.read("suppressions"))
        occ = wh.read("occurrences").join(groups.select(F.col("id").alias("group_id"), "group_hash"), "group_id")
        gone = wh.read("occurrence_suppressions").select("group_hash", F.col("file_path").alias("path")).distinct()
        kept = occ.join(gone, ["group_hash", "path"], "left_anti")
        enough = kept.groupBy("group_id").agg(F.count("*").alias("n")).filter("n >= 2").select("group_id")
        groups = groups.join(enough, groups["id"] == enough["group_id"], "left_semi")
        return analytics.tiers(store.group_details(groups, kept.drop("group_hash")), tier, languages, F.try_element_at("occurrences", F.lit(1))["path"])

    def list(self, format: str = "text", tier: str = "both", languages: tuple[str, ...] = ()) -> DataFrame:
        """One row per visible group in order: ``ordinal`` and its text, json or sarif rendering."""
        first = F.col("occurrences")[0]
        details = cut(self.details(tier, languages))
        order = with_ordinal(details.select("id", "tier", first["path"].alias("p"), first["start_line"].alias("l")), [F.col("tier"), F.col("p"), F.col("l"), F.col("id")])
        ranked = details.join(order.select("id", "ordinal"), "id")
        body = {"text": lambda: report.group_text(ranked, "ordinal"), "json": lambda: report.group_json(ranked), "sarif": lambda: report.sarif_result(ranked)}[format]()
        return ranked.select("id", "ordinal").join(body, "id").orderBy("ordinal")

    def write_list(self, path: str, format: str = "json") -> None:
        """Text or NDJSON as a folder of parts; SARIF as one document, streamed group by group."""
        rows = self.list(format)
        if format != "sarif":
            rows.select(rows.columns[-1]).write.mode("overwrite").text(path)
            return
        with open(path, "w", encoding="utf-8") as f:
            f.write(report.SARIF_HEAD)
            for i, r in enumerate(rows.toLocalIterator()):
                f.write("," * bool(i) + r["result"])
            f.write(report.SARIF_TAIL)

    def show(self, group_id: int, format: str = "text") -> str:
        """One group, dismissed or not."""
        wh = self._open()
        one = store.group_details(wh.read("match_groups").filter(F.col("id") == group_id), wh.read("occurrences").filter(F.col("group_id") == group_id))
        row = (report.group_text(one) if format == "text" else report.group_json(one.withColumn("one", F.lit(1)), "one")).first()
        if row is None:
            raise KeyError(group_id)
        return row[1]

    def suppressions(self) -> DataFrame:
        return self._open().read("suppressions").orderBy("dismissed_at", hex16(F.col("group_hash")))

    def issues(self) -> dict[str, int]:
        """Counts by kind; empty when all went well."""
        return {r["kind"]: r["count"] for r in self._open().read("issues").groupBy("kind").count().collect()}

    def diff(self, since: str, now: int | None = None) -> DataFrame:
        """Groups new, gone, grown or shrunk between a past scan and the newest."""
        wh = self._open()
        scans = history.scans_view(wh.read("scans"))
        head = scans.orderBy(F.desc("started_at"), F.desc("scan_id")).first()
        base = history.resolve_since(scans, since, int(time.time()) if now is None else now)
        if head is None or base is None or base == head["scan_id"]:
            raise ValueError(f"{since!r} names no earlier scan")
        rows = wh.read("scan_groups")
        found = history.diff(rows.filter(F.col("scan_id") == base), rows.filter(F.col("scan_id") == head["scan_id"]), ["group_hash"])
        return found.withColumn("folder_hash", F.lit(head["folder_hash"])).withColumn("hash", hex16(F.col("group_hash"))).orderBy("hash")

    # -- dismissals

    def dismiss(self, group_id: int, path: str | None = None, now: int | None = None) -> None:
        """Dismiss a group, or its occurrences in one file."""
        wh = self._open()
        at = int(time.time()) if now is None else now
        with wh.lock():
            group = wh.read("match_groups").filter(F.col("id") == group_id)
            if group.isEmpty():
                raise KeyError(group_id)
            if path is None:
                rows = group.select("group_hash", F.lit(at).cast("bigint").alias("dismissed_at"), F.col("id").alias("last_group_id"))
                wh.commit({"suppressions": suppress.dismiss(wh.read("suppressions"), rows, ["group_hash"])})
            else:
                rows = group.select("group_hash", F.lit(path).alias("file_path"), F.lit(at).cast("bigint").alias("dismissed_at"))
                wh.commit({"occurrence_suppressions": suppress.dismiss(wh.read("occurrence_suppressions"), rows, ["group_hash", "file_path"])})

    def undismiss(self, hash_hex: str, path: str | None = None) -> int:
        """Take back dismissals of a hash, of all its files or of one; how many there were."""
        wh = self._open()
        name = "suppressions" if path is None else "occurrence_suppressions"
        with wh.lock():
            table = wh.read(name)
            rows = table.filter(F.col("group_hash") == unhex16(F.lit(hash_hex)))
            if path not in (None, "*"):
                rows = rows.filter(F.col("file_path") == path)
            keys = ["group_hash"] if path is None else ["group_hash", "file_path"]
            count = rows.count()
            if count:
                wh.commit({name: suppress.undismiss(table, rows, keys)})
        return count

    def clear_suppressions(self, occurrences: bool = False) -> int:
        wh = self._open()
        name = "occurrence_suppressions" if occurrences else "suppressions"
        count = wh.read(name).count()
        wh.commit({name: wh.read(name).limit(0)})
        return count

    # -- the rest

    def strict_exit(self) -> int:
        """1 if anything visible is left, for use in checks."""
        return int(not self.details().isEmpty())

    def clean(self, yes: bool = False) -> bool:
        folder = Folder(self.spark, self.warehouse)
        if yes and folder.exists():
            folder.delete()
            return True
        return False

    def config_paths(self) -> str:
        return json.dumps({p: os.path.exists(p) for p in (settings.global_path(), settings.project_path(self.root))})


__all__ = ["WINDOW", "Engine", "fnv1a", "resolve_format"]
