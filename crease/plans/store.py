"""A store of tables whose partitions are replaced by writing beside them and then naming the new ones in one manifest.

A change writes whole partitions of any number of tables into new folders. Readers see none of it until the change's
manifest is there, which one rename makes; a change that breaks off leaves folders that nothing names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crease.plans.shared import rows_seen

#: Folders that a table may be spread over before a change writes it into one again.
MOST_FOLDERS = 40


class StoreConflict(RuntimeError):
    """Another change was published since this one began."""


class Store:
    """Tables under one path. layout: the partition columns of each table, of which it has few values."""

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, list[str]]):
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout

    # files, by Spark's own file systems

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def snapshot(self) -> int:
        """The number of the newest published change, 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, snapshot: int | None = None) -> dict:
        """Of each table its schema and the folder that has each of its partitions."""
        number = self.snapshot() if snapshot is None else snapshot
        if not number:
            return {}
        stream = self._files().open(self._path("manifests", f"{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, snapshot: int | None = None) -> DataFrame | None:
        """A table as a change left it; None if no change has written it. Filters on partition columns prune folders."""
        return self._read(table, self.manifest(snapshot))

    def _read(self, table: str, manifest: dict, with_part: bool = False) -> DataFrame | None:
        """with_part: and the partition's folder, as `part_folder`."""
        if table not in manifest:
            return None
        entry = manifest[table]
        schema = StructType.fromJson(entry["schema"])
        folders: dict[str, list[str]] = {}
        for part, folder in entry["parts"].items():
            folders.setdefault(folder, []).append(part)
        reads = []
        for folder, parts in sorted(folders.items()):
            base = f"{self.path}/{table}/{folder}"
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" for p in sorted(parts)])
            if with_part:
                rows = rows.select(*rows.columns, F.regexp_extract("_metadata.file_path", f"/{folder}/(.*)/[^/]+$", 1).alias("part_folder"))
            reads.append(rows)
        return reduce(DataFrame.unionByName, reads) if reads else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what none of the last `keep` manifests names, and older manifests; returns the number of folders deleted.

        Not while a change is being written, and `keep` covers the oldest snapshot that is still being read.
        """
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))
        kept = [self.manifest(n) for n in numbers[-keep:]]
        files, gone = self._files(), 0
        for table, by in self.layout.items():
            named = {(folder, part) for m in kept for part, folder in m.get(table, {"parts": {}})["parts"].items()}
            for folder in self._names(table):
                unnamed = [p for p in self._partitions(table, folder, len(by)) if (folder, p) not in named]
                for p in [""] if not any(f == folder for f, _ in named) else unnamed:
                    files.delete(self._path(table, folder, *([p] if p else [])), True)
                    gone += 1
        for n in numbers[:-keep]:
            files.delete(self._path("manifests", f"{n:010d}.json"), False)
        return gone

    def _partitions(self, table: str, folder: str, depth: int) -> list[str]:
        """The partitions of a folder, as paths in it."""
        found = [""]
        for _ in range(depth):
            found = [f"{p}/{n}".lstrip("/") for p in found for n in self._names(table, folder, *([p] if p else [])) if "=" in n]
        return found


class Change:
    """Writes to several tables that are seen together, once publish() has been called. What it reads is the state before."""

    def __init__(self, store: Store):
        self.store = store
        self.base = store.snapshot()
        self.before = store.manifest(self.base)
        self.after = {t: {"schema": e["schema"], "parts": dict(e["parts"])} for t, e in self.before.items()}

    def read(self, table: str) -> DataFrame | None:
        """The table as it was before the change."""
        return self.store._read(table, self.before)

    def written(self, table: str) -> DataFrame | None:
        """The table as the change has it so far."""
        return self.store._read(table, self.after)

    def replace_all(self, table: str, rows: DataFrame) -> dict:
        return self._write(table, rows, None)

    def replace_partitions(self, table: str, rows: DataFrame, partitions: list[str]) -> dict:
        """Replace these partitions (folders such as `part=3`), and those that rows has values of, by rows."""
        return self._write(table, rows, partitions if table in self.after else None)

    def places(self, table: str, key: list[str], keys: DataFrame) -> list[Row]:
        """The partitions of the table that have a group named by keys, each with its folder as `part_folder`."""
        if table not in self.after:
            return []
        by = self.store.layout[table]
        reads = self.store._read(table, self.after, with_part=True).select(*by, *key, "part_folder")
        return reads.join(keys, key, "left_semi").groupBy(*by).agg(F.min("part_folder").alias("part_folder")).collect()

    def replace_groups(
        self, table: str, rows: DataFrame, key: list[str], keys: DataFrame | None = None, had: list[Row] | None = None, gets: DataFrame | None = None
    ) -> dict:
        """Replace every group (such as a match) that `keys` names, by default those of `rows`, by its rows in `rows`, if it has any.

        Only partitions that have such groups, or get some, are written again. rows and keys are read several times, so
        they are written tables. had: places() of a table partitioned alike, outside of which no named group stands; gets:
        a table that has all partition values of rows. They spare the looks for both; with gets, rows are read once.
        """
        old = self.written(table)
        if old is None:
            return self._write(table, rows, None)
        by = self.store.layout[table]
        keys = (rows if keys is None else keys).select(*key).distinct()
        had = self.places(table, key, keys) if had is None else had
        found = (rows if gets is None else gets).select(*by).distinct().collect()
        touched = {tuple(r[c] for c in by) for r in [*had, *found]}
        if not touched:
            return {"partitions": 0, "rows": 0}
        inside = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, values, strict=True)]) for values in sorted(touched, key=str)])
        kept = old.filter(inside).join(keys, key, "left_anti").select(*old.columns)
        return self._write(table, kept.unionByName(rows.select(*old.columns)), [unquote(r["part_folder"]) for r in had])

    def _write(self, table: str, rows: DataFrame, replaced: list[str] | None) -> dict:
        """Write rows into a folder of their own; they stand for their partitions and for the replaced ones, or for all.

        Small partitions share tasks and large ones are split by size, so that the number of files follows the rows.
        """
        by = self.store.layout[table]
        folder = f"{self.base + 1:010d}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        dealt = rows.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", *by)
        dealt.write.partitionBy(*by).option("compression", "zstd").parquet(f"{self.store.path}/{table}/{folder}")
        names = self.store._partitions(table, folder, len(by))
        parts = {} if replaced is None else self.after[table]["parts"]
        parts = {p: f for p, f in parts.items() if p not in (replaced or [])} | dict.fromkeys(names, folder)
        self.after[table] = {"schema": json.loads(StructType([f for f in rows.schema.fields]).json()), "parts": parts}
        if len(set(parts.values())) > MOST_FOLDERS:
            return self._write(table, self.written(table), None)
        return {"partitions": len(names), "rows": rows_seen(seen)}

    def publish(self) -> int:
        """Make the change seen: its manifest is written beside and renamed. Returns the snapshot's number."""
        files, number = self.store._files(), self.base + 1
        files.mkdirs(self.store._path("manifests"))
        beside, name = self.store._path("manifests", f".{uuid.uuid4().hex}"), self.store._path("manifests", f"{number:010d}.json")
        stream = files.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(self.after, indent=1).encode()))
        finally:
            stream.close()
        if files.exists(name) or not files.rename(beside, name):
            files.delete(beside, False)
            raise StoreConflict(f"snapshot {number} is there already")
        return number
