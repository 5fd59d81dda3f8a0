"""Tables that change in place, over plain Parquet: several tables under one manifest, switched in one step.

The rows of a table are dealt to buckets by a hash of its key. A change reads and writes the buckets of the keys it touches and no other;
the new files lie beside the old ones, and become the table when the next manifest (``_versions/<number>.json``: for each table its schema, and for
each bucket the folders that hold it) is put in place by one rename. Until then, and after a crash at any point before it, every
reader sees the last version whole, in all tables alike; files that no manifest names are dropped by ``vacuum``.

A change may carry the name and the number of a batch. The manifest remembers the highest number of each name, in the same step, so a
batch that is run again changes nothing.

Two writers that start from one version both want the same next number; the rename of the second fails and its change is made anew on top of
the first. This needs a file system on which a rename does not replace a file (HDFS and local disks; not object stores).

Through the driver go bucket numbers and the manifest: a table has a fixed number of buckets, so neither grows with its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources.scratch import ROW_GROUP_BYTES, swept, writer


class Change(NamedTuple):
    """``rows`` of the buckets that hold ``keys`` (a DataFrame with the table's key column) become ``how(rows)``; without ``how``, ``keys``
    are whole rows that are added to them, and what is there is neither read nor written. Where ``how`` leaves rows in their buckets
    (``stays``: it changes or drops rows, but adds none and changes no key) they are written by the tasks that read them. A table of one bucket
    can take a ``folder`` of ``Store.written`` as it is. Added rows that are ``dealt`` (``Store.dealt``) are written by the tasks that hold them.
    A change that is done ``apart`` meets some buckets at a time, by ``how(rows, keys of these buckets)``, and adds no rows: what it shuffles
    does not grow with the table."""

    table: str
    keys: DataFrame | None
    how: Callable[..., DataFrame] | None = None
    stays: bool = False
    folder: str | None = None
    dealt: bool = False
    apart: bool = False


#: Bytes of the buckets that a change done apart meets at a time; one bucket at least.
PASS_BYTES = 128 << 20


class ConcurrentChange(Exception):
    """Another writer put the same version in place first."""


class Store:
    """``tables`` maps a name to ``(schema, key, buckets)``; it is needed where the store is new."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str | T.StructType, str, int]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if self.version() is None:
            if tables is None:
                raise ValueError(f"no store at {path}")
            empty = {name: {"schema": self._json(schema), "key": key, "buckets": buckets, "folders": {}} for name, (schema, key, buckets) in tables.items()}
            try:
                self._switch(0, {"tables": empty, "batches": {}})
            except ConcurrentChange:
                pass

    def _json(self, schema: str | T.StructType) -> str:
        return (schema if isinstance(schema, T.StructType) else self.spark.createDataFrame([], schema).schema).json()

    # the manifest

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The number of the current version; None where there is no store yet."""
        files, folder = self._files(), self._path("_versions")
        if not files.exists(folder):
            return None
        found = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(f.removesuffix(".json")) for f in found if f.endswith(".json") and not f.startswith((".", "_"))), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        stream = self._files().open(self._path("_versions", f"{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _switch(self, version: int, manifest: dict) -> None:
        files, target = self._files(), self._path("_versions", f"{version}.json")
        draft = self._path("_versions", f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise ConcurrentChange(f"version {version} of {self.path} was put in place by another writer")

    # reading

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table, in the current or an earlier version."""
        return self._read(self.manifest(version)["tables"][name], None)

    def _read(self, table: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        folders = [f for b, own in sorted(table["folders"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest()["tables"][name]["schema"]))

    def filled(self, name: str) -> bool:
        """Whether the table has any files."""
        return bool(self.manifest()["tables"][name]["folders"])

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys; buckets without one of them are not read."""
        table = self.manifest()["tables"][name]
        return self._read(table, self._buckets(table, keys)).join(keys.select(table["key"]).distinct(), table["key"], "left_semi")

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` written once beside the tables, and read back; ``vacuum`` drops them."""
        return self.written(rows)[1]

    def written(self, rows: DataFrame, group_bytes: int = ROW_GROUP_BYTES, compression: str | None = None) -> tuple[str, DataFrame]:
        """``staged`` rows and their folder, which ``adopt`` makes part of a table."""
        folder = f"data/staged-{uuid.uuid4().hex}"
        with swept(self.spark):
            writer(rows, group_bytes, compression).parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")

    def dropped(self, folder: str) -> None:
        """Delete a folder of ``written`` that no table has taken and no later job reads."""
        self._files().delete(self._path(*folder.split("/")), True)

    def dealt(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with those of one bucket of a table together; ``key`` is the column that has the table's keys."""
        table = self.manifest()["tables"][name]
        return rows.repartition(table["buckets"], self._bucket(table, key))

    def _bucket(self, table: dict, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or table["key"]), F.lit(table["buckets"])).cast("int")

    def _passes(self, table: dict, buckets: list[int]) -> list[list[int]]:
        """The buckets in groups of ``PASS_BYTES``; those without files are in none."""
        out, room, files = [], 0, self._files()
        for b in buckets:
            if own := table["folders"].get(str(b)):
                size = sum(files.getContentSummary(self._path(*f.split("/"))).getLength() for f in own)
                if size > room:
                    out.append([])
                    room = PASS_BYTES
                out[-1].append(b)
                room -= size
        return out

    def _buckets(self, table: dict, keys: DataFrame) -> list[int]:
        kind = T.StructType.fromJson(json.loads(table["schema"]))[table["key"]].dataType
        rows = keys.select(F.col(table["key"]).cast(kind).alias(table["key"]))
        return sorted(r.bucket for r in rows.select(self._bucket(table).alias("bucket")).distinct().collect())

    # changing

    def commit(self, changes: Callable[[Store], list[Change]], batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Apply changes to one or more tables as one version; returns its number.

        ``changes`` is called with this store and may read it; it is called again where another writer was first. A batch whose number is not
        above the last one of its name changes nothing.
        """
        for left in range(tries - 1, -1, -1):
            manifest = self.manifest()
            if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return manifest["version"]
            try:
                return self._apply(manifest, changes(self), batch)
            except ConcurrentChange:
                if not left:
                    raise

    def _apply(self, manifest: dict, changes: list[Change], batch: tuple[str, int] | None) -> int:
        tables = {name: t | {"folders": dict(t["folders"])} for name, t in manifest["tables"].items()}
        for change in changes:
            table = tables[change.table]
            schema = T.StructType.fromJson(json.loads(table["schema"]))
            one = table["buckets"] == 1
            if change.folder is not None:
                if not one:
                    raise ValueError(f"the rows of {change.table} go to buckets")
                table["folders"]["0"] = [*table["folders"].get("0", []), change.folder]
                continue
            touched = [0] if one else [] if change.how is None else self._buckets(table, change.keys)
            if not touched and change.how is not None:
                continue
            for own in self._passes(table, touched) if change.apart else [touched]:
                if change.how is None:
                    new = change.keys
                elif change.apart:
                    keys = change.keys.select(F.col(table["key"]).cast(schema[table["key"]].dataType).alias(table["key"])).distinct()
                    new = change.how(self._read(table, own), keys if one else keys.where(self._bucket(table).isin(own)))
                else:
                    new = change.how(self._read(table, own))
                new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
                folder = f"data/{change.table}-{uuid.uuid4().hex}"
                if one:
                    writer(new).parquet(f"{self.path}/{folder}")
                    table["folders"]["0"] = [*(table["folders"].get("0", []) if change.how is None else []), folder]
                    continue
                bucketed = new.withColumn("_bucket", self._bucket(table))
                placed = bucketed if change.stays or change.dealt else bucketed.repartition(len(own) or table["buckets"], "_bucket")
                with swept(self.spark):
                    writer(placed, compression="zstd").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                names = [f.getPath().getName() for f in self._files().listStatus(self._path(*folder.split("/")))]
                written = {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}
                for b in written | set(own):
                    before = table["folders"].pop(str(b), [])
                    now = [*(before if change.how is None else []), *([f"{folder}/_bucket={b}"] if b in written else [])]
                    if now:
                        table["folders"][str(b)] = now
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._switch(manifest["version"] + 1, {"tables": tables, "batches": batches})
        return manifest["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` versions and the folders that none of these names; returns how many folders went.

        Run it while nothing is being written: the files of a change that has not been put in place look like those of a crash.
        """
        files, last = self._files(), self.version()
        versions = sorted(int(f.getPath().getName().removesuffix(".json")) for f in files.listStatus(self._path("_versions")) if f.getPath().getName().endswith(".json"))
        kept = [v for v in versions if v > last - keep]
        named = {f.split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for own in t["folders"].values() for f in own}
        for v in versions:
            if v not in kept:
                files.delete(self._path("_versions", f"{v}.json"), False)
        gone = 0
        if files.exists(self._path("data")):
            for f in files.listStatus(self._path("data")):
                if f.getPath().getName() not in named:
                    files.delete(f.getPath(), True)
                    gone += 1
        return gone


def upsert(table: str, key: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Change:
    """The rows of the touched buckets merged with ``rows`` by ``merge(old, rows)``."""
    return Change(table, rows.select(key), lambda old: merge(old, rows))


def replace(table: str, key: str, keys: DataFrame, rows: DataFrame) -> Change:
    """All rows of ``keys`` (also those with nothing in their place) give way to ``rows``, which belong to these keys."""
    return Change(table, keys.select(key), lambda old: old.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True))


def patch(table: str, key: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Change:
    """The rows that ``rows`` speaks of are changed by ``change(old, rows)``, a left join: nothing is added, nothing moves to another bucket.
    ``rows`` should be ``Store.staged``, so that Spark knows its size and sends a small patch to the tasks that read the table."""
    return Change(table, rows.select(key), lambda old: change(old, rows), stays=True)


def append(table: str, rows: DataFrame, dealt: bool = False) -> Change:
    return Change(table, rows, dealt=dealt)


def adopt(table: str, folder: str) -> Change:
    """Add the files of ``Store.written`` to a table of one bucket; their columns must be the table's."""
    return Change(table, None, folder=folder)


def exchange(table: str, key: str, keys: DataFrame, rows: DataFrame) -> list[Change]:
    """``replace`` for large changes: ``rows`` are ``dealt`` and written where they lie, beside what the buckets keep, which is read some buckets at a time."""
    return [Change(table, keys.select(key), lambda old, gone: old.join(gone, key, "left_anti"), apart=True), append(table, rows, dealt=True)]


def delete(table: str, key: str, keys: DataFrame) -> Change:
    return Change(table, keys.select(key), lambda old: old.join(keys.select(key).distinct(), key, "left_anti"), stays=True)
