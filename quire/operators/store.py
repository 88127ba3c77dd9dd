"""Keyed tables in buckets: a batch rewrites only the buckets it touches, and one manifest commits it.

A table's rows lie in buckets by the hash of its key. A batch reads the touched buckets, writes their next
rows to new folders and then puts one manifest in place, which names the folder of every bucket of every
table. Readers take the newest manifest, so they see all of a batch or nothing. Writers number their batches;
one that is run again after its commit changes nothing, and one that failed before it is written anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
BUCKET = "_bucket"


@dataclass(frozen=True)
class Keyed:
    """Columns of a table, the key whose rows change together, and its number of buckets.

    Take as many buckets as the table has multiples of 128 MB, and not more than some ten thousand: a
    manifest has a line for each.
    """

    schema: str
    key: str = "paper_id"
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Edit:
    """The keys that a batch touches, and the next rows of their buckets from the present ones.

    `make` gets all rows of the touched buckets and must hand back those of other keys as they are, as
    `ledger.replace_group`, `ledger.upsert` and `ledger.delete_papers` do.
    """

    keys: DataFrame
    make: Callable[[DataFrame], DataFrame]


class _Files:
    """Names and renames in whatever file system the folder lies in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def put(self, text: str, target: str) -> None:
        """A new file, whole or not at all."""
        part = self.path(f"{target}.part")
        out = self.fs.create(part, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self.fs.exists(self.path(target)) or not self.fs.rename(part, self.path(target)):
            raise RuntimeError(f"{target} was put in place by another writer")

    def drop(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


@dataclass(frozen=True)
class Manifest:
    """State after a commit: its version, the last batch of each writer and, by table, the folder of each
    bucket that has rows."""

    version: int = -1
    writers: Mapping[str, int] = field(default_factory=dict)
    folders: Mapping[str, Mapping[int, str]] = field(default_factory=dict)


class Store:
    """Tables and logs below one folder of the shared storage, with one writer at a time.

    `logs` are tables that only grow: a batch adds one partition, which counts once it is committed.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Keyed], logs: Mapping[str, str] | None = None) -> None:
        self.spark, self.root, self.tables, self.logs = spark, root.rstrip("/"), dict(tables), dict(logs or {})
        self.files = _Files(spark, self.root)

    def _names(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]

    def _manifest(self, name: str) -> Manifest:
        told = json.loads(self.spark.read.text(f"{self.root}/manifests/{name}", wholetext=True).first()[0])
        return Manifest(told["version"], told["writers"], {t: {int(b): f for b, f in own.items()} for t, own in told["folders"].items()})

    def manifest(self) -> Manifest:
        """The newest committed state."""
        names = self._names()
        return self._manifest(names[-1]) if names else Manifest()

    def _rows(self, name: str, manifest: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        own = manifest.folders.get(name, {})
        paths = [f"{self.root}/{folder}" for b, folder in sorted(own.items()) if buckets is None or b in buckets]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """A table or log as the last commit left it. Logs have a column `version`."""
        manifest = self.manifest()
        if name in self.tables:
            return self._rows(name, manifest)
        schema = f"{self.logs[name]}, version bigint"
        if manifest.version < 0 or not self.files.names(f"{self.root}/logs/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/logs/{name}").where(F.col("version") <= manifest.version)

    def one(self, name: str, key: object) -> DataFrame:
        """Rows of one key, from its bucket alone."""
        spec = self.tables[name]
        at = self.spark.range(1).select(F.lit(key).alias(spec.key)).select(spec.bucket()).first()[0]
        return self._rows(name, self.manifest(), [at]).where(F.col(spec.key) == key)

    def apply(self, batch: int, edits: Mapping[str, Edit], logs: Mapping[str, DataFrame] | None = None, writer: str = "") -> bool:
        """Run a batch and commit it; False if this writer has committed it, or a later one, before.

        What reaches the driver is the numbers of the touched buckets. A hot key's bucket is written by
        several tasks, because the rows are rebalanced by size.
        """
        before = self.manifest()
        if batch <= before.writers.get(writer, -1):
            return False
        version = before.version + 1
        folders = {name: dict(own) for name, own in before.folders.items()}
        for name, edit in edits.items():
            spec = self.tables[name]
            touched = [r[0] for r in edit.keys.select(spec.bucket().alias(BUCKET)).distinct().collect()]
            if not touched:
                continue
            columns = self.spark.createDataFrame([], spec.schema).columns
            after = edit.make(self._rows(name, before, touched)).select(*columns, spec.bucket().alias(BUCKET))
            folder = f"data/{name}/version={version}"
            after.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
            made = {int(n.split("=")[1]) for n in self.files.names(f"{self.root}/{folder}") if n.startswith(f"{BUCKET}=")}
            if not made <= set(touched):
                raise ValueError(f"{name}: the edit gave rows of keys it does not name")
            own = folders.setdefault(name, {})
            for b in touched:
                own.pop(b, None)
                if b in made:
                    own[b] = f"{folder}/{BUCKET}={b}"
        for name, rows in (logs or {}).items():
            columns = self.spark.createDataFrame([], self.logs[name]).columns
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/logs/{name}/version={version}")
        state = {"version": version, "writers": {**before.writers, writer: batch}, "folders": folders}
        self.files.put(json.dumps(state), f"{self.root}/manifests/{version:012d}.json")
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete bucket folders that none of the last `keep` manifests names; gives their names."""
        names = self._names()
        used = {folder for n in names[-keep:] for own in self._manifest(n).folders.values() for folder in own.values()}
        last, gone = self.manifest().version, []
        for table in self.tables:
            for version in self.files.names(f"{self.root}/data/{table}"):
                if int(version.split("=")[1]) > last:
                    continue  # of a batch that is being written
                for bucket in self.files.names(f"{self.root}/data/{table}/{version}"):
                    folder = f"data/{table}/{version}/{bucket}"
                    if bucket.startswith(BUCKET) and folder not in used:
                        self.files.drop(f"{self.root}/{folder}")
                        gone.append(folder)
        return gone
