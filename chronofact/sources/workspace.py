"""A folder of stage results in the shared store: written once, found by what they were made of, removed by age or name."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import filesystem, shared_dir

#: Where a workspace keeps its tables, those still being written, and what it knows of them.
TABLES, OPEN, MANIFEST = "tables", "open", "manifest"
ENTRY = "name string, stage string, content string, version string, settings string, made double"


class Workspace:
    """Results of stages by content: stage, version and settings of what they were made from.

    A table is written beside its place and renamed into it, so a reader sees whole tables only and of two writers the
    first one's stays; an entry of the manifest follows. Names lead nowhere outside the folder.
    """

    def __init__(self, spark: SparkSession, name: str = "workspace", folder: str | None = None):
        self.spark, self.folder = spark, f"{(folder or shared_dir(spark)).rstrip('/')}/{self._plain(name)}"

    @staticmethod
    def _plain(name: str) -> str:
        if not name or name.startswith(".") or set(name) & set("/\\:"):
            raise ValueError(f"{name!r} is no plain name")
        return name

    def path(self, *parts: str) -> str:
        """A path inside the workspace."""
        return "/".join([self.folder, *map(self._plain, parts)])

    @staticmethod
    def key(content: str, stage: str, version: str = "1", settings: dict | None = None) -> str:
        told = json.dumps([content, stage, version, settings or {}], sort_keys=True)
        return f"{stage}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def get(self, name: str) -> DataFrame | None:
        """The table of a key, or None while there is none."""
        store, at = filesystem(self.spark, self.path(TABLES, name))
        return self.spark.read.parquet(str(at)) if store.exists(at) else None

    def get_or_make(self, content: str, stage: str, make: Callable[[], DataFrame], version: str = "1", settings: dict | None = None) -> DataFrame:
        """The table made of this before, else what make() returns, kept."""
        name = self.key(content, stage, version, settings)
        found = self.get(name)
        if found is None:
            draft = self.path(OPEN, f"{name}-{uuid.uuid4().hex}")
            make().write.parquet(draft)
            store, at = filesystem(self.spark, self.path(TABLES, name))
            store.mkdirs(at.getParent())
            _, written = filesystem(self.spark, draft)
            if store.exists(at) or not store.rename(written, at):
                store.delete(written, True)
            row = (name, stage, content, version, json.dumps(settings or {}, sort_keys=True), time.time())
            self.spark.createDataFrame([row], ENTRY).coalesce(1).write.mode("append").json(self.path(MANIFEST))
            found = self.get(name)
        return found

    def manifest(self) -> DataFrame:
        """What the workspace holds: an entry for each table that is there."""
        store, at = filesystem(self.spark, self.path(MANIFEST))
        if not store.exists(at):
            return self.spark.createDataFrame([], ENTRY)
        there = [(n,) for n in self._names(TABLES)]
        last = self.spark.read.schema(ENTRY).json(str(at)).groupBy("name").agg(F.max_by(F.struct("stage", "content", "version", "settings", "made"), "made").alias("e")).select("name", "e.*")
        return last.join(self.spark.createDataFrame(there, "name string"), "name", "left_semi")

    def _names(self, kind: str) -> list[str]:
        store, at = filesystem(self.spark, self.path(kind))
        return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []

    def _drop(self, kind: str, names: list[str]) -> int:
        for n in names:
            store, at = filesystem(self.spark, f"{self.path(kind)}/{n}")
            store.delete(at, True)
        return len(names)

    def invalidate(self, stage: str) -> int:
        """Remove a stage's tables; returns how many."""
        return self._drop(TABLES, [n for n in self._names(TABLES) if n.rsplit("-", 1)[0] == stage])

    def sweep(self, hours: float) -> int:
        """Remove tables, and drafts that no writer finished, that are older than so many hours."""
        gone = 0
        for kind in (TABLES, OPEN):
            store, at = filesystem(self.spark, self.path(kind))
            if store.exists(at):
                old = [x.getPath().getName() for x in store.listStatus(at) if x.getModificationTime() < 1000 * (time.time() - 3600 * hours)]
                gone += self._drop(kind, old)
        return gone

    def clear(self) -> None:
        """Remove all that the workspace holds."""
        store, at = filesystem(self.spark, self.folder)
        store.delete(at, True)
