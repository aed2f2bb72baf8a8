"""Atomic publication of several tables: versioned folders and a manifest that names them.

Every write goes to new folders.  A version comes to be by one rename of a small manifest file, which lists
the folders of all its tables; readers take the highest version and read only what it lists.  So a reader
sees all of a batch or none of it, a failure before the rename leaves nothing but unlisted folders, and a reader
that has begun keeps its version's files until they are vacuumed.  Two writers that start from the same
version cannot both commit: the second finds its number taken.

Files are reached through Hadoop's FileSystem, as Spark reaches them.  Where a rename is not atomic (some object
stores) the manifest is still one small file, written whole before it is renamed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"
#: Versions whose files :meth:`Store.vacuum` keeps.
KEEP = 2


class CommitConflict(RuntimeError):
    """Another writer committed a version since this one was read."""


@dataclass
class Version:
    """Number (0: nothing published) and, per table, its parts: part name -> folder below the store."""

    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    def with_parts(self, parts: dict[str, dict[str, str]]) -> "Version":
        """The version that follows when these parts are added or replaced."""
        tables = {t: dict(p) for t, p in self.tables.items()}
        for table, new in parts.items():
            tables.setdefault(table, {}).update(new)
        return Version(self.number, tables)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.folder}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.folder}/{MANIFESTS}/{number}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(number, json.loads(text))

    def current(self) -> Version:
        """The published version."""
        numbers = self._numbers()
        return self.version(numbers[-1]) if numbers else Version()

    def stage(self, table: str, df: DataFrame, partition_by: list[str] = ()) -> str:
        """Write ``df`` where no version lists it yet; returns its folder below the store."""
        place = f"{table}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.folder}/{place}")
        return place

    def commit(self, version: Version) -> Version:
        """Publish ``version`` (read as :meth:`current`, then changed) as the next number."""
        number = version.number + 1
        folder = f"{self.folder}/{MANIFESTS}"
        self._fs.mkdirs(self._path(folder))
        ready, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number}.json")
        stream = self._fs.create(ready, False)
        stream.write(bytearray(json.dumps(version.tables, sort_keys=True).encode()))
        stream.close()
        taken = self._numbers()[-1:] != ([version.number] if version.number else [])
        if taken or self._fs.exists(final) or not self._fs.rename(ready, final):
            self._fs.delete(ready, False)
            raise CommitConflict(f"version {number} of {self.folder} is taken")
        return Version(number, version.tables)

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """The table as the version has it, all parts together; None if it has none."""
        places = sorted((version or self.current()).tables.get(table, {}).values())
        frames = [self.spark.read.option("basePath", f"{self.folder}/{p}").parquet(f"{self.folder}/{p}") for p in places]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def vacuum(self, keep: int = KEEP) -> int:
        """Delete the folders that none of the last ``keep`` versions lists, and the manifests before these.
        Run it when no writer is at work: folders staged but not committed go too.  Returns the folders deleted."""
        numbers = self._numbers()
        live = {p for n in numbers[-keep:] for parts in self.version(n).tables.values() for p in parts.values()}
        known = {t for n in numbers for t in self.version(n).tables}
        gone = 0
        for table in known:
            at = self._path(f"{self.folder}/{table}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if f"{table}/{s.getPath().getName()}" not in live:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{MANIFESTS}/{n}.json"), False)
        return gone
