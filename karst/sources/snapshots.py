"""A store of several tables that change together.

A version is a small file that names, for each table, the folder with its rows. A commit writes the changed tables into
folders of its own and then creates the next version's file, last and only if no other commit has: until then readers see
the version before, whole, and what a lost run wrote is in no version. Tables that a commit doesn't write stay where they are.
Retried tasks are settled by Spark's own committer within a table's folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import place


class Conflict(RuntimeError):
    """Another commit came first; read its version and commit again on top of it."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ----------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        fs, where = place(self.spark, f"{self.root}/versions")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self) -> int:
        """The newest, 0 before the first commit."""
        return max(self.versions(), default=0)

    def told(self, version: int | None = None) -> dict[str, Any]:
        """tables (name to folder and schema) and note of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "note": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(self._file(version), wholetext=True).collect()))  # one small file

    def _file(self, version: int) -> str:
        return f"{self.root}/versions/{version:020d}.json"

    def read(self, table: str, version: int | None = None, empty: str | None = None) -> DataFrame:
        """A table as of a version. empty: the schema of a table that the version doesn't have."""
        found = self.told(version)["tables"].get(table)
        if found is None:
            if empty is None:
                raise KeyError(f"no table {table}")
            return self.spark.createDataFrame([], empty)
        return self.spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{self.root}/{found['folder']}")

    # ----------------------------------------------------------------- commits

    def stage(self) -> Stage:
        return Stage(self)

    def commit(self, tables: Mapping[str, DataFrame], base: int | None = None, note: Mapping[str, Any] | None = None) -> int:
        """Writes the tables, then the version after base (the newest by default, which the tables should be made from)."""
        stage = Stage(self, base)
        for name, df in tables.items():
            stage.write(name, df)
        return stage.commit(note)

    def vacuum(self, keep: int = 2, older_s: float = 24 * 3600) -> int:
        """Drops all but the newest `keep` versions, and folders that none of those names and that are older than a run may
        last; returns how many folders went."""
        kept = self.versions()[-keep:]
        fs, data = place(self.spark, f"{self.root}/data")
        used = {f["folder"].split("/")[1] for v in kept for f in self.told(v)["tables"].values()}
        for v in self.versions()[:-keep]:
            fs.delete(place(self.spark, self._file(v))[1], False)
        gone = 0
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in used and now - s.getModificationTime() >= older_s * 1000:
                gone += fs.delete(s.getPath(), True)
        return gone


class Stage:
    """A commit in the making: tables are written one by one, and can be read back, before any of them is in a version."""

    def __init__(self, store: Store, base: int | None = None):
        self.store, self.base = store, store.version() if base is None else base
        self.folder = f"data/{uuid.uuid4().hex}"
        self.made: dict[str, dict] = {}

    def write(self, table: str, df: DataFrame) -> DataFrame:
        folder = f"{self.folder}/{table}"
        df.write.option("compression", "zstd").parquet(f"{self.store.root}/{folder}")
        self.made[table] = {"folder": folder, "schema": json.loads(df.schema.json())}
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{folder}")

    def commit(self, note: Mapping[str, Any] | None = None, drop: tuple[str, ...] = ()) -> int:
        """Creates the version. drop: tables that were only needed on the way."""
        kept = {k: v for k, v in self.made.items() if k not in drop}
        told = {"tables": {**self.store.told(self.base)["tables"], **kept}, "note": dict(note or {})}
        self._create(self.base + 1, json.dumps(told))
        for name in drop:
            fs, where = place(self.store.spark, f"{self.store.root}/{self.made[name]['folder']}")
            fs.delete(where, True)
        return self.base + 1

    def _create(self, version: int, text: str) -> None:
        """A version's file comes whole or not at all: written beside, then renamed to a name that must be free."""
        jvm, conf = self.store.spark.sparkContext._jvm, self.store.spark.sparkContext._jsc.hadoopConfiguration()
        fs, beside = place(self.store.spark, f"{self.store.root}/versions/_{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = place(self.store.spark, self.store._file(version))[1]
        option = jvm.org.apache.hadoop.fs.Options.Rename
        free = self.store.spark.sparkContext._gateway.new_array(option, 1)
        free[0] = option.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, final, free)
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise
