"""Append-only tables with versions that are committed as a whole.

    path/data/<batch>/...      Parquet, never changed after it is written
    path/versions/<number>     the batches that make up a version, one a line

A version file is written under another name and renamed without overwriting, so a version is either there with all
of its batches or not at all: a writer that dies leaves the last version as it was, and of two writers one wins and the
other tries again on top of it. Readers hold a version and are not disturbed by later ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, tuple(partition_by)

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _system(self):
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """Number of the last version, 0 before the first."""
        folder = self._file("versions")
        if not self._system().exists(folder):
            return 0
        names = [status.getPath().getName() for status in self._system().listStatus(folder)]
        return max((int(name) for name in names if name.isdigit()), default=0)

    def batches(self, version: int | None = None) -> list[str]:
        version = self.latest() if version is None else version
        if not version:
            return []
        stream = self._system().open(self._file("versions", f"{version:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [line for line in text.split("\n") if line]

    def read(self, version: int | None = None, batches: Sequence[str] | None = None) -> DataFrame:
        names = self.batches(version) if batches is None else list(batches)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        tables = [f"{self.path}/data/{name}" for name in names]
        read = self.spark.read.schema(self.schema)
        if not self.partition_by:
            return read.parquet(*tables)
        parts = [read.option("basePath", table).parquet(table) for table in tables]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def write(self, rows: DataFrame) -> str:
        """A batch that no version names yet."""
        name = uuid.uuid4().hex
        rows.select(*self.schema.names).write.partitionBy(*self.partition_by).parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, version: int, batches: Sequence[str]) -> bool:
        """Make `version` consist of `batches`; False if that version is there already."""
        system, jvm = self._system(), self.spark._jvm
        system.mkdirs(self._file("versions"))
        draft, final = self._file("versions", f"_{uuid.uuid4().hex}"), self._file("versions", f"{version:012d}")
        out = system.create(draft, False)
        out.write(bytearray("\n".join(batches).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(system.makeQualified(draft), system.makeQualified(final), no_overwrite)
            return True
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise

    def append(self, rows: DataFrame, since: int, without: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Add `rows`, made on top of version `since`; returns the new version.

        If others have committed meanwhile, `without(rows, their batches)` says which rows are still to be added.
        """
        while True:
            known = self.batches(since)
            name = self.write(rows)
            if self.commit(since + 1, [*known, name]):
                return since + 1
            now = self.latest()
            if without is not None:
                rows = without(rows, self.read(batches=[b for b in self.batches(now) if b not in known]))
            since = now

    def replace(self, rows: DataFrame, since: int) -> bool:
        """A version with `rows` as its only batch, as compaction writes it; False if `since` is not the last version any more."""
        return self.commit(since + 1, [self.write(rows)])

    def vacuum(self, keep: int = 1) -> int:
        """Delete batches that none of the last `keep` versions names; returns how many. Not while others write."""
        last = self.latest()
        named = {name for version in range(max(1, last - keep + 1), last + 1) for name in self.batches(version)}
        folder, gone = self._file("data"), 0
        for status in self._system().listStatus(folder) if self._system().exists(folder) else []:
            if status.getPath().getName() not in named:
                self._system().delete(status.getPath(), True)
                gone += 1
        return gone
