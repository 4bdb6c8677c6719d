"""Stored tables that change together, by a log of snapshots.

Data lies in folders that never change once written.  A snapshot is a small
JSON file in the folder's log that names the data of every table; it appears
as a whole or not at all (written aside, then renamed without overwriting), so
a run that is killed leaves the snapshot before it readable, and of two writers
that start from the same snapshot one gets a ``Conflict``.  Readers pin a
snapshot and do not see later ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the next snapshot first; read it and try again."""


class Snapshots:
    """The log below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, *names: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _listed(self, *names: object) -> list[str]:
        fs, at = self._fs(), self._at(*names)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._listed("_log") if n.endswith(".json") and n[:1].isdigit()]

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """What a snapshot, by default the newest, holds; empty where there is none."""
        version = self.latest() if version is None else version
        if version is None:
            return {}
        stream = self._fs().open(self._at("_log", f"{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, df: DataFrame, kind: str, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> str:
        """Writes df as a data folder and returns its name; no snapshot names it yet."""
        name = f"{kind}-{uuid.uuid4().hex}"
        writer = df.write.options(**({"compression": "zstd"} | (options or {})))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        return name

    def commit(self, manifest: dict, base: int | None) -> int:
        """Makes manifest the snapshot after base (None: the first one) and returns its number."""
        version = 0 if base is None else base + 1
        fs, aside, there = self._fs(), self._at("_log", f"tmp-{uuid.uuid4().hex}"), self._at("_log", f"{version:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf).rename(aside, there, none)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(there):
                raise Conflict(f"snapshot {version} is there already") from e
            raise
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the log's entries but the newest ``keep`` and data that these do not name; returns the names.

        Not to be run while a writer is at work: what it has not committed yet is named by no snapshot.
        """
        held = self.versions()[-max(1, keep) :]
        named = " ".join(json.dumps(self.manifest(v)) for v in held)
        gone = [n for n in self._listed() if n != "_log" and n not in named] if held else []
        gone += [f"_log/{n}" for n in self._listed("_log") if n.startswith("tmp-") or int(n.split(".")[0]) not in held]
        for name in gone:
            self._fs().delete(self._at(name), True)
        return gone


class Tables:
    """Keyed tables in one log: a row lies in the bucket of its key, and a change writes the touched buckets anew.

    The number of buckets is fixed when a table is made; choose it so that a
    bucket is what a change may rewrite (some hundred MB).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log, self.spark = Snapshots(spark, path), spark

    def _bucket(self, key: str, n: int):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")

    def _write(self, name: str, df: DataFrame, key: str, n: int) -> str:
        """A bucket's rows are dealt over as many tasks as their size asks for."""
        return self.log.put(df.withColumn("_bucket", self._bucket(key, n)).hint("rebalance", "_bucket"), name, ("_bucket",))

    def create(self, tables: dict[str, tuple[DataFrame, str]], buckets: int = 64) -> int:
        """The first snapshot: name to (rows, key)."""
        manifest = {"tables": {}, "meta": {}}
        for name, (df, key) in tables.items():
            folder = self._write(name, df, key, buckets)
            manifest["tables"][name] = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": dict.fromkeys(self._filled(folder), folder)}
        return self.log.commit(manifest, None)

    def _filled(self, folder: str) -> list[str]:
        return [n.split("=")[1] for n in self.log._listed(folder) if n.startswith("_bucket=")]

    def read(self, name: str, version: int | None = None, *, only: set[str] | None = None) -> DataFrame:
        """A table as of a snapshot, by default the newest."""
        return self._rows(self.log.manifest(version)["tables"][name], only)

    def _rows(self, table: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.log.path}/{folder}/_bucket={b}" for b, folder in table["folders"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def meta(self, version: int | None = None) -> dict[str, str]:
        """What the snapshot says of itself."""
        return dict(self.log.manifest(version).get("meta", {}))

    def change(self, edits: dict[str, Callable[[DataFrame], DataFrame]], keys: dict[str, DataFrame], base: int | None = None, meta: dict[str, str] | None = None) -> int:
        """One snapshot in which each named table's touched buckets are edits[name](their rows) and meta is set.

        keys[name] has the keys that an edit touches, in one column; only their buckets are read and written.
        """
        base = self.log.latest() if base is None else base
        manifest = self.log.manifest(base)
        for name, edit in edits.items():
            table = manifest["tables"][name]
            column = keys[name].columns[0]
            touched = {str(r[0]) for r in keys[name].select(self._bucket(column, table["buckets"])).distinct().collect()}  # a number for each bucket at most
            schema = StructType.fromJson(table["schema"])
            rows = edit(self._rows(table, touched)).select(*schema.fieldNames())
            folder = self._write(name, rows, table["key"], table["buckets"])
            if not set(self._filled(folder)) <= touched:
                raise ValueError(f"the edit of {name} gave rows of keys that it did not name")
            table["folders"] = {b: f for b, f in table["folders"].items() if b not in touched} | dict.fromkeys(self._filled(folder), folder)
        manifest["meta"] = manifest.get("meta", {}) | (meta or {})
        return self.log.commit(manifest, base)

    def replace(self, changes: dict[str, DataFrame], base: int | None = None) -> int:
        """In each named table all rows of the changes' keys make way for the changes, in one snapshot."""
        key = {n: self.log.manifest(base)["tables"][n]["key"] for n in changes}

        def edit(n: str) -> Callable[[DataFrame], DataFrame]:
            return lambda rows: rows.join(changes[n].select(key[n]).distinct(), key[n], "left_anti").select(*rows.columns).unionByName(changes[n].select(*rows.columns))

        edits = {n: edit(n) for n in changes}
        return self.change(edits, {n: df.select(key[n]) for n, df in changes.items()}, base)

    def delete(self, ids: DataFrame, names: list[str] | None = None, base: int | None = None) -> int:
        """The ids' rows go from all named tables (all there are) in one snapshot; ids has one column."""
        tables = self.log.manifest(base)["tables"]
        gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
        names = list(tables) if names is None else names
        edits = {n: (lambda rows, k=tables[n]["key"]: rows.join(gone, rows[k] == gone["_gone"], "left_anti")) for n in names}
        return self.change(edits, {n: gone for n in names}, base)
