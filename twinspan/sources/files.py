"""Small files and folders of the store through the Hadoop file system, so that any shared one will do."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Folder:
    """A folder on the file system that its path names (``file:`` where it names none and none is configured)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root
        path = self._path("")
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(path.getFileSystem(self.conf).getUri(), self.conf)
        self.fs.setVerifyChecksum(False)  # small text files that people may mend by hand
        self.fs.setWriteChecksum(False)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Write and close; without ``overwrite`` an existing file is an error, which makes it a lock."""
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Rename over an existing file in one step."""
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        context.rename(self._path(source), self._path(target), options)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    @contextmanager
    def lock(self, name: str = "_lock", wait: float = 60.0, stale: float = 6 * 3600.0) -> Iterator[None]:
        """One writer at a time; a lock older than ``stale`` seconds is a dead writer's and is broken."""
        until = time.time() + wait
        while True:
            try:
                self.write(name, str(time.time()), overwrite=False)
                break
            except Exception as e:  # the file system's own class of error
                held = self.read(name)
                if held is None and not self.exists():
                    raise
                if held and time.time() - float(held) > stale:
                    self.delete(name)
                elif time.time() > until:
                    raise TimeoutError(f"{self.root} is locked by another writer") from e
                else:
                    time.sleep(0.2)
        try:
            yield
        finally:
            self.delete(name)
