"""Versioned snapshots of small and large tables, with an exclusive writer and an atomic swap.

A store is a folder of version folders and a pointer file, on any file system that Hadoop knows. A
write makes a new version and then moves the pointer, so that a table can be rewritten while it is
read, and a data table and its manifest can change together. A table may have several parts, of which
later ones replace the documents that they hold; a write then costs what is new.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.ingest import manifest_remove, manifest_upsert
from spindrift.schema import MANIFEST

#: Seconds after which a lock file is taken to be left over, and between looks at it.
LEASE, WAIT = 3600.0, 0.2
#: Parts of a table after which it is rewritten as one.
MOST_PARTS = 16


class Folder:
    """Small files of a folder, on this machine or through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.root = str(root).rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._new_array = spark.sparkContext._gateway.new_array
        self._fs = self._path("").getFileSystem(self._conf)
        #: The folder on this machine, if that is where it is.
        self.local = Path(self._fs.makeQualified(self._path("")).toUri().getPath()) if self._fs.getUri().getScheme() == "file" else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return (self.local / name).exists() if self.local else self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        if self.local:
            return (self.local / name).read_text(encoding="utf-8")
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Write a file and have it reach the disk; without ``overwrite``, only one of several can."""
        if self.local:
            self.local.mkdir(parents=True, exist_ok=True)
            with (self.local / name).open("w" if overwrite else "x", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            return
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(text.encode("utf-8"))
            stream.hflush()
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Rename over an existing file, in one step where the file system can."""
        if self.local:
            os.replace(self.local / source, self.local / target)
            return
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        files.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), options)

    def age(self, name: str) -> float:
        if self.local:
            return time.time() - (self.local / name).stat().st_mtime
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def children(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(name))] if self.exists(name) else []


@contextlib.contextmanager
def exclusive(folder: Folder, lease: float = LEASE) -> Iterator[None]:
    """A lock between processes that share the folder: flock on a local one, elsewhere a file that only
    one can create. A file older than the lease is left over from a process that died."""
    if folder.local is not None:
        folder.local.mkdir(parents=True, exist_ok=True)
        with (folder.local / "_LOCK").open("a") as file:
            try:
                import fcntl
            except ImportError:
                yield
                return
            fcntl.flock(file, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(file, fcntl.LOCK_UN)
        return
    while True:
        try:
            folder.write("_LOCK", uuid.uuid4().hex, overwrite=False)
            break
        except Exception:  # another process has it; whatever else is wrong shows when the file is looked at
            if folder.exists("_LOCK") and folder.age("_LOCK") > lease:
                folder.remove("_LOCK")
            elif not folder.exists("_LOCK") and not folder.exists(""):
                raise
            time.sleep(WAIT)
    try:
        yield
    finally:
        folder.remove("_LOCK")


class SnapshotStore:
    """Tables by name under one pointer. ``keys``: of tables with parts, the column whose values a later
    part replaces."""

    def __init__(self, spark: SparkSession, root: str | Path, schemas: Mapping[str, T.StructType], keys: Mapping[str, str] | None = None):
        self.spark, self.root, self.schemas, self.keys = spark, str(root).rstrip("/"), dict(schemas), dict(keys or {})
        self.folder = Folder(spark, self.root)

    def lock(self) -> contextlib.AbstractContextManager[None]:
        return exclusive(self.folder)

    def current(self) -> dict[str, list[str]]:
        """Version folders by table; a corrupt pointer is an error and is never overwritten."""
        if not self.folder.exists("_CURRENT"):
            return {}
        return {name: [where] if isinstance(where, str) else where for name, where in json.loads(self.folder.read("_CURRENT")).items()}

    def read(self, name: str) -> DataFrame:
        parts, schema = self.current().get(name, []), self.schemas[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if len(parts) == 1:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{parts[0]}")
        rows = None
        for i, where in enumerate(parts):
            one = self.spark.read.schema(schema).parquet(f"{self.root}/{where}").withColumn("_part", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
        key = self.keys[name]
        last = rows.groupBy(key).agg(F.max("_part").alias("_part"))
        return rows.join(last, [key, "_part"], "left_semi").select(*schema.fieldNames())

    def last_part(self, name: str) -> DataFrame:
        """The rows that were written last."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{self.current()[name][-1]}")

    def _write(self, name: str, df: DataFrame) -> str:
        where = f"{name}/v-{uuid.uuid4().hex[:12]}"
        df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schemas[name].fields]).write.parquet(f"{self.root}/{where}")
        return where

    def _point(self, versions: Mapping[str, list[str]]) -> None:
        aside = f"_CURRENT.{uuid.uuid4().hex[:8]}"
        self.folder.write(aside, json.dumps(versions))
        self.folder.replace(aside, "_CURRENT")

    def commit(self, **tables: DataFrame) -> None:
        """Write new versions of the tables, then swap the pointer once for all of them."""
        self._point(self.current() | {name: [self._write(name, df)] for name, df in tables.items()})

    def append(self, name: str, df: DataFrame) -> bool:
        """Add a part that replaces the documents in it; nothing changes if it has no rows. After
        MOST_PARTS the table becomes one part again. Returns whether there were rows."""
        where = self._write(name, df)
        if self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{where}").isEmpty():
            self.folder.remove(where)
            return False
        versions = self.current()
        versions[name] = [*versions.get(name, []), where]
        self._point(versions)
        if len(versions[name]) > MOST_PARTS:
            self.commit(**{name: self.read(name)})
        return True

    def vacuum(self, grace: float = LEASE) -> int:
        """Delete versions that the pointer left behind, once they are older than any reader may be."""
        used, gone = {w for parts in self.current().values() for w in parts}, 0
        for name in self.schemas:
            for child in self.folder.children(name):
                if f"{name}/{child}" not in used and self.folder.age(f"{name}/{child}") >= grace:
                    self.folder.remove(f"{name}/{child}")
                    gone += 1
        return gone


class ManifestStore:
    """The manifest table (store, pdf_name, file_hash), changed under the lock."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.files = spark, SnapshotStore(spark, root, {"manifest": MANIFEST})

    def load(self, store: str) -> DataFrame:
        with self.files.lock():
            return self._own(store)

    def update(self, store: str, updates: DataFrame | Mapping[str, str]) -> None:
        """Insert or replace entries; nothing is written for an empty mapping."""
        if isinstance(updates, Mapping):
            if not updates:
                return
            updates = self.spark.createDataFrame([*updates.items()], "pdf_name string, file_hash string")
        with self.files.lock():
            self._replace(store, manifest_upsert(self._own(store), updates))

    def remove(self, store: str, names: list[str]) -> int:
        """Remove entries; returns how many there were. Written only if there was any, under the lock
        under which they were counted."""
        gone = self.spark.createDataFrame([(n,) for n in set(names)], "pdf_name string")
        with self.files.lock():
            own = self._own(store)
            found = own.join(gone, "pdf_name", "left_semi").count()
            if found:
                self._replace(store, manifest_remove(own, gone))
        return found

    def _own(self, store: str) -> DataFrame:
        return self.files.read("manifest").where(F.col("store") == store).select("pdf_name", "file_hash")

    def _replace(self, store: str, own: DataFrame) -> None:
        others = self.files.read("manifest").where(F.col("store") != store)
        self.files.commit(manifest=others.unionByName(own.withColumn("store", F.lit(store)).select("store", "pdf_name", "file_hash")))
