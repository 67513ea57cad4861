"""A keyed table of Parquet folders for several writers at once: numbered commits, each created only if its number is free.

A commit is a small file that lists the folders of its snapshot with the commit that each one came with, so readers see
one snapshot or the next. A writer first writes its rows to a folder of its own and then claims the next number; if
another writer was faster, it looks at that snapshot and claims the number after it. Rows are put in by appending:
of the rows of a key the one of the latest commit counts, and a row may say that its key is gone. ``compact`` rewrites a
snapshot as one folder, ``vacuum`` removes old commits and what only they refer to.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.functions.shared import filesystem

GONE, AT = "_gone", "_at"


class Taken(Exception):
    """Another writer has the number."""


class VersionedTable:
    """The table under a path with rows of ``keys``; ``unique`` is a column of which no two keys may hold the same value."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], unique: str | None = None, attempts: int = 50):
        self.spark, self.path, self.keys, self.unique, self.attempts = spark, path.rstrip("/"), keys, unique, attempts

    def versions(self) -> list[int]:
        """The numbers of all commits that are there."""
        fs, at = filesystem(self.spark, f"{self.path}/_commits")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self, version: int) -> list[list]:
        fs, at = filesystem(self.spark, f"{self.path}/_commits/{version:012d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, version: int, folders: list[list]) -> None:
        """Write the commit aside and move it to its number, which fails if the number is taken: a link on a local disk, else a rename."""
        fs, aside = filesystem(self.spark, f"{self.path}/_commits/_{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, to = filesystem(self.spark, f"{self.path}/_commits/{version:012d}")
        try:
            if fs.getScheme() == "file":
                local = lambda p: urlparse(p.toString()).path
                os.link(local(fs.makeQualified(aside)), local(fs.makeQualified(to)))
            else:
                jvm = self.spark.sparkContext._jvm
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(to), none)
        except FileExistsError as e:
            raise Taken(version) from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Taken(version) from e
            raise
        finally:
            fs.delete(aside, False)

    def _write(self, rows: DataFrame) -> str:
        name = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, change: Callable[[int, list[list]], list[list]]) -> int:
        """Publish what change makes of the last (version, folders), again after each conflict; the number of the commit."""
        for _ in range(self.attempts):
            last = (self.versions() or [0])[-1]
            folders = change(last, self._folders(last) if last else [])
            try:
                self._publish(last + 1, folders)
                return last + 1
            except Taken:
                continue
        raise RuntimeError(f"{self.attempts} other commits came first")

    def _rows(self, folders: list[list]) -> DataFrame:
        """The rows that count, of the latest commit for each key."""
        known = F.create_map(*[F.lit(x) for name, version in folders for x in (name, version)])
        read = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{name}" for name, _ in folders))
        read = read.withColumn(AT, known[F.regexp_extract("_metadata.file_path", "/(d-[0-9a-f]{32})/", 1)])
        last = W.partitionBy(*self.keys).orderBy(F.desc(AT))
        return read.withColumn("_r", F.row_number().over(last)).where(f"_r = 1 AND NOT {GONE}").drop("_r", AT, GONE)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The snapshot of a commit, the last one by default; None where nothing was ever committed."""
        version = version or (self.versions() or [0])[-1]
        return self._rows(self._folders(version)) if version else None

    def _one_a_key(self, rows: DataFrame) -> DataFrame:
        order = W.partitionBy(*self.keys).orderBy(F.desc(F.to_json(F.struct("*"))))
        return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").withColumn(GONE, F.lit(False))

    def upsert(self, rows: DataFrame) -> int:
        """Put the rows in, in place of those of their keys. Other keys that hold a value of ``unique`` are removed."""
        name = self._write(self._one_a_key(rows))

        def change(version: int, folders: list[list]) -> list[list]:
            more = []
            if self.unique and folders:
                mine = self.spark.read.parquet(f"{self.path}/{name}").select(self.unique, *(F.col(k).alias(f"_{k}") for k in self.keys))
                other = ~F.array(*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys)).eqNullSafe(F.array(*[F.lit(True)] * len(self.keys)))
                old = self._rows(folders)
                stale = old.join(mine, self.unique).where(other).select(*old.columns).distinct().withColumn(GONE, F.lit(True))
                more = [[self._write(stale), version]]
            return [*folders, *more, [name, version + 1]]

        return self.commit(change)

    def insert_missing(self, rows: DataFrame) -> int:
        """Put in the rows of keys that are not there; the others are left as they are."""
        rows = self._one_a_key(rows)

        def change(version: int, folders: list[list]) -> list[list]:
            new = rows
            if folders:
                there = self._rows(folders).select(*(F.col(k).alias(f"_{k}") for k in self.keys))
                new = rows.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
            return [*folders, [self._write(new), version + 1]]

        return self.commit(change)

    def delete(self, condition: str) -> int:
        """Remove the rows for which the condition holds."""

        def change(version: int, folders: list[list]) -> list[list]:
            return [*folders, [self._write(self._rows(folders).where(condition).withColumn(GONE, F.lit(True))), version + 1]] if folders else folders

        return self.commit(change)

    def compact(self) -> int:
        """The same rows as one folder."""
        return self.commit(lambda version, folders: [[self._write(self._rows(folders).withColumn(GONE, F.lit(False))), version + 1]] if folders else folders)

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> list[str]:
        """Remove all commits but the last ``keep`` and the folders that no other refers to and that are older than ``grace`` seconds: younger ones may be on their way."""
        versions = self.versions()
        used = {name for v in versions[-keep:] for name, _ in self._folders(v)}
        fs, top = filesystem(self.spark, self.path)
        for v in versions[:-keep]:
            fs.delete(filesystem(self.spark, f"{self.path}/_commits/{v:012d}")[1], False)
        old = [s for s in fs.listStatus(top) if s.getPath().getName().startswith("d-") and s.getPath().getName() not in used] if fs.exists(top) else []
        gone = [s.getPath().getName() for s in old if s.getModificationTime() / 1000 < time.time() - grace]
        for name in gone:
            fs.delete(filesystem(self.spark, f"{self.path}/{name}")[1], True)
        return gone


def import_results(table: VersionedTable, folder: str, schema: str, required: list[str]) -> int:
    """Put the result files (one JSON object each) of a folder into a table keyed by result_file; the number of the commit.

    Files that are no JSON object, or lack one of the required fields or have it empty, are skipped; files that are there
    already change nothing.
    """
    files = table.spark.read.option("wholetext", True).text(folder, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("result_file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    filled = [F.coalesce(F.trim(F.col(f"r.{c}").cast("string")) != "", F.lit(False)) for c in required]
    rows = files.where(F.col("r").isNotNull() & F.array(*filled).eqNullSafe(F.array(*[F.lit(True)] * len(filled)))).select("result_file", "r.*")
    return table.insert_missing(rows)
