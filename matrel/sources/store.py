"""Stores: a folder of Parquet tables as a database of keyed records."""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import read_text, write_text


class Store:
    """Tables under one path. A table is a list of folders, of records and of erased keys, in a numbered manifest file; a
    write makes new folders and then puts the next manifest in place by a rename that fails if another writer was there
    first. So readers see the old table or the new one, small writes cost what they write, and no write is lost. Folders
    of older manifests go when the table is rewritten as a whole; those of the last one are kept, as they may be read."""

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd"):
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = hadoop.Path

    def tables(self) -> list[str]:
        return sorted(n for s in self._list(self.path) if s.isDirectory() and self._number(n := s.getPath().getName()) >= 0)

    def _list(self, path: str) -> list:
        p = self._path(path)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _number(self, name: str) -> int:
        found = [s.getPath().getName() for s in self._list(f"{self.path}/{name}")]
        return max((int(n[9:17]) for n in found if n.startswith("manifest-")), default=-1)

    def _parts(self, name: str) -> tuple[int, list[list[str]]]:
        """(manifest number, [kind, folder, key column] of the parts in order); kind is data or erased."""
        number = self._number(name)
        return (number, json.loads(read_text(self.spark, f"{self.path}/{name}/manifest-{number:08d}"))) if number >= 0 else (-1, [])

    def read(self, name: str) -> DataFrame:
        _, parts = self._parts(name)
        if not parts:
            raise KeyError(name)
        out = None
        for kind, run in itertools.groupby(parts, key=lambda p: (p[0], p[2])):
            rows = self.spark.read.parquet(*(f"{self.path}/{name}/{folder}" for _, folder, _ in run))
            if kind[0] == "erased":
                out = out.join(rows.distinct(), kind[1], "left_anti")
            else:
                out = rows if out is None else out.unionByName(rows)
        return out

    def _add(self, name: str, rows: DataFrame, kind: str = "data", key: str = "") -> list[str]:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", self.compression).parquet(f"{self.path}/{name}/{folder}")
        return [kind, folder, key]

    def _commit(self, name: str, number: int, parts: list[list[str]]) -> DataFrame:
        place, draft = f"{self.path}/{name}/manifest-{number:08d}", f"{self.path}/{name}/draft-{uuid.uuid4().hex}"
        write_text(self.spark, draft, json.dumps(parts))
        if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(draft), self._path(place)):
            self._fs.delete(self._path(draft), False)
            raise RuntimeError(f"{name} was written by another writer meanwhile")
        return self.read(name)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table anew."""
        number, parts = self._parts(name)
        before = json.loads(read_text(self.spark, f"{self.path}/{name}/manifest-{number - 1:08d}")) if number > 0 and self._fs.exists(self._path(f"{self.path}/{name}/manifest-{number - 1:08d}")) else []
        out = self._commit(name, number + 1, [self._add(name, df)])
        kept = {folder for _, folder, _ in parts}
        for _, folder, _ in before:
            if folder not in kept:
                self._fs.delete(self._path(f"{self.path}/{name}/{folder}"), True)
        return out

    def upsert(self, name: str, rows: DataFrame, key: str = "key") -> DataFrame:
        """Records of rows replace those of the same key."""
        number, parts = self._parts(name)
        if not parts:
            return self.write(name, rows)
        added = self._add(name, rows)
        keys = self.spark.read.parquet(f"{self.path}/{name}/{added[1]}").select(key).distinct()
        return self._commit(name, number + 1, [*parts, self._add(name, keys, "erased", key), added])

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        number, parts = self._parts(name)
        return self._commit(name, number + 1, [*parts, self._add(name, rows)])

    def erase(self, name: str, keys: DataFrame, key: str = "key") -> DataFrame:
        number, parts = self._parts(name)
        return self._commit(name, number + 1, [*parts, self._add(name, keys.select(key).distinct(), "erased", key)]) if parts else self.read(name)

    def lock(self) -> bool:
        """Take the store for one user; false if it is taken. Writes do not ask: the lock is between those who do."""
        self._fs.mkdirs(self._root)
        return self._fs.createNewFile(self._path(f"{self.path}/_lock"))

    def unlock(self) -> bool:
        return self._fs.delete(self._path(f"{self.path}/_lock"), False)

    def keys(self, name: str, key: str = "key") -> DataFrame:
        return self.read(name).select(key).distinct()

    def all_keys(self, key: str = "key") -> DataFrame:
        found = [self.keys(n, key) for n in self.tables()]
        out = found[0]
        for k in found[1:]:
            out = out.union(k)
        return out.distinct()

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def rename(self, old: str, new: str) -> None:
        self._fs.rename(self._path(f"{self.path}/{old}"), self._path(f"{self.path}/{new}"))

    def defragment(self, name: str, files: int = 1) -> DataFrame:
        """The table rewritten in a number of files."""
        return self.write(name, self.read(name).repartition(files))

    def statistics(self, key: str = "key") -> DataFrame:
        parts = [self.read(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).withColumn("bytes", F.lit(self._fs.getContentSummary(self._path(f"{self.path}/{n}")).getLength())) for n in self.tables()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def merge(self, other: Store, key: str = "key") -> None:
        """Records of another store's tables are put into this one's."""
        for name in other.tables():
            self.upsert(name, other.read(name), key)

    def split(self, name: str, directory: str, key: str = "key") -> None:
        """One folder for each key."""
        self.read(name).write.partitionBy(key).parquet(directory)
