"""The store on disk: versioned Parquet tables that are replaced as a whole.

A write goes to a new folder; the pointer file is swapped last, so a reader
sees the old tables or the new ones, never a mixture, and a failed job leaves
the old ones in place. History tables are appended as one folder per scan.
Every change from reading to the swap is made under a lock. All files go
through the Hadoop file system, so the store may lie on any shared one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from twinspan.operators.lexing import FILES
from twinspan.operators.units import UNITS
from twinspan.sources.files import Folder

SCHEMA_VERSION = 5
SCHEMAS = {
    "match_groups": "id bigint, group_hash bigint, hash_hex string, tier string, occurrence_count bigint, total_lines bigint, total_tokens bigint",
    "occurrences": "id bigint, group_id bigint, path string, start_line int, end_line int, start_byte int, end_byte int, alpha array<struct<s:int,e:int,idx:int>>",
    "suppressions": "group_hash bigint, dismissed_at bigint, last_group_id bigint",
    "occurrence_suppressions": "group_hash bigint, file_path string, dismissed_at bigint",
    "file_blocks": "path string, content_hash bigint, size bigint, mtime bigint, block_hashes array<bigint>",
    "issues": "path string, kind string, message string",
    "scans": "scan_id bigint, started_at bigint, folder_hash bigint, git_commit string",
    "scan_groups": "scan_id bigint, group_hash bigint, occurrence_count bigint, total_lines bigint",
    "file_state": "path string, length bigint, mtime bigint, status string, message string, content_hash bigint, profile string",
    "file_windows": FILES,
    "file_units": UNITS,
}


def _legacy_version(state: dict) -> dict:
    """The first stores wrote ``version`` and had the three tables of groups and dismissals only."""
    return {"schema_version": 1, "tables": state.get("tables", {})}


def _new_tables(*names: str) -> Callable[[dict], dict]:
    return lambda state: state | {"tables": {n: [] for n in names} | state["tables"]}


#: What a store of each version needs to be one of the next; columns that a table lacks are null when read.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {
    0: _legacy_version,
    1: _new_tables("file_blocks", "issues"),
    2: _new_tables("occurrence_suppressions"),
    3: _new_tables("scans", "scan_groups"),
    4: _new_tables("file_state", "file_windows", "file_units"),
}


class NewerStore(RuntimeError):
    """The store was written by a later version and is left alone."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, create: bool = True):
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)
        self._locked = False
        if create:
            self.folder.make()
            if not self.folder.exists(".gitignore"):
                self.folder.write(".gitignore", "*\n")
        state = self.state()
        if state["schema_version"] > SCHEMA_VERSION:
            raise NewerStore(f"schema {state['schema_version']} is newer than {SCHEMA_VERSION}")
        if create and state["schema_version"] < SCHEMA_VERSION:
            self.migrate()

    @staticmethod
    def open_readonly(spark: SparkSession, root: str) -> Warehouse | None:
        """None where there is no store."""
        return Warehouse(spark, root, False) if Folder(spark, root).exists("_state.json") else None

    def state(self) -> dict:
        text = self.folder.read("_state.json")
        if text is None:
            return {"schema_version": SCHEMA_VERSION, "tables": {}}
        state = json.loads(text)
        return state if "schema_version" in state else state | {"schema_version": 0}

    def migrate(self) -> None:
        """Step by step to the present version; each step is one swap."""
        with self.lock():
            while (state := self.state())["schema_version"] < SCHEMA_VERSION:
                version = state["schema_version"]
                self._write_state(MIGRATIONS[version](state) | {"schema_version": version + 1})

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Held from reading to the swap by whoever changes tables; may be nested."""
        if self._locked:
            yield
            return
        with self.folder.lock():
            self._locked = True
            try:
                yield
            finally:
                self._locked = False

    def _write_state(self, state: dict) -> None:
        temporary = f"_state.{uuid.uuid4().hex}"
        self.folder.write(temporary, json.dumps(state))
        self.folder.replace(temporary, "_state.json")

    def read(self, name: str) -> DataFrame:
        """Columns that an older table lacks are null."""
        folders = self.state().get("tables", {}).get(name, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
        df.select(*columns).write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, settings: str | None = None) -> None:
        """Replace and append tables together; old versions go after the swap. ``settings`` says what the groups were made with."""
        with self.lock():
            state = self.state()
            before = state["tables"]
            new = {n: [self._write(n, df)] for n, df in (replace or {}).items()}
            new |= {n: [*before.get(n, []), self._write(n, df)] for n, df in (append or {}).items()}
            self._write_state({"schema_version": SCHEMA_VERSION, "tables": before | new, "settings": settings or state.get("settings")})
        for n in replace or {}:
            for folder in before.get(n, []):
                self.folder.delete(folder)

    def clean(self) -> None:
        self.folder.delete()
