"""Tables as Parquet snapshots under one manifest, with copy-on-write changes and staged commits over several tables.

A manifest is a small JSON file that names each table's folders; appending rows adds a folder and rewrites nothing. A transaction writes new folders first and then one new
manifest with the next number; creating that file is the commit, and it fails if another writer was faster. Readers pin
the manifest they opened. Files are reached through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another transaction committed first, or a unique key exists already."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """The number of the newest manifest; 0 for an empty store."""
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return 0
        return max((int(s.getPath().getName().removesuffix(".json")) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.folders(self.manifest(version)[table])

    def folders(self, names: list[str], schema: StructType | None = None) -> DataFrame:
        """The rows of some folders of a table; columns that one lacks are null there. No file is opened to learn a schema given."""
        reader = self.spark.read.option("mergeSchema", "true") if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/{name}" for name in names))

    def buckets(self, folder: str, by: str) -> DataFrame:
        """The rows of a folder that was written in buckets of `by`, so that joins and groups by it need no shuffle."""
        name, count = bucketed_name(folder)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.folders([folder]).schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {count} BUCKETS LOCATION '{self.qualified(folder)}'")
        return self.spark.table(name)

    def qualified(self, folder: str) -> str:
        return self.fs.makeQualified(self._path(folder)).toString()

    def begin(self) -> Transaction:
        return Transaction(self)


def bucketed_name(folder: str) -> tuple[str, int]:
    """The session's table for a folder `.../<hexadecimal>.<buckets>`, and the number of buckets."""
    name, count = folder.rpartition("/")[2].split(".")
    return f"fieldloom_{name}", int(count)


class Transaction:
    """Changes that become visible together or not at all. States: pending, prepared, committed, aborted."""

    def __init__(self, store: SnapshotStore):
        self.store, self.base, self.state = store, store.version(), "pending"
        self.held, self.staged, self.new, self.passing = store.manifest(self.base), {}, [], []

    def _folders(self, table: str) -> list[str]:
        return self.staged[table] if table in self.staged else self.held.get(table, [])

    def _current(self, table: str) -> DataFrame:
        return self.store.folders(self._folders(table))

    def _written(self, table: str, rows: DataFrame, *by: str) -> str:
        if self.state != "pending":
            raise ConflictError(f"the transaction is {self.state}")
        folder = f"data/{table}/{uuid.uuid4().hex}"
        self.new.append(folder)
        rows.write.partitionBy(*by).parquet(f"{self.store.root}/{folder}")
        return folder

    def replace(self, table: str, rows: DataFrame) -> DataFrame:
        """Put rows in place of all that the table has, and give them back as written."""
        self.staged[table] = [self._written(table, rows)]
        return self.store.folders(self.staged[table], rows.schema)

    def scratch(self, rows: DataFrame, *by: str) -> DataFrame:
        """Rows as written to a folder that goes when the transaction ends, with a folder in it for each value of `by`."""
        folder = self._written("scratch", rows, *by)
        self.passing.append(folder)
        return self.store.folders([folder], rows.schema)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table, new or not, and give them back as written."""
        folder = self._written(table, rows)
        self.staged[table] = [*self._folders(table), folder]
        return self.store.folders([folder], rows.schema)

    def append_parts(self, table: str, rows: DataFrame, by: str) -> None:
        """Add rows with a folder for each value of `by`, a column that is not kept; the folders can be forgotten one by one."""
        folder = self._written(table, rows, by)
        parts = [s.getPath().getName() for s in self.store.fs.listStatus(self.store._path(folder)) if s.isDirectory()]
        self.staged[table] = [*self._folders(table), *(f"{folder}/{part}" for part in sorted(parts) if part.startswith(f"{by}="))]

    def append_buckets(self, table: str, rows: DataFrame, by: str, order: list[str], buckets: int) -> None:
        """Add rows in buckets of `by`, one file each and sorted, as a folder for SnapshotStore.buckets; none if there are no rows."""
        if self.state != "pending":
            raise ConflictError(f"the transaction is {self.state}")
        folder, watch = f"data/laid/{uuid.uuid4().hex}.{buckets}", Observation()
        self.new.append(folder)
        spread = rows.observe(watch, F.count(F.lit(1)).alias("n")).repartition(buckets, by).sortWithinPartitions(*order)
        spread.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", self.store.qualified(folder)).saveAsTable(bucketed_name(folder)[0])
        if watch.get.get("n", 0):
            self.staged[table] = [*self._folders(table), folder]
            return
        self.store.spark.sql(f"DROP TABLE {bucketed_name(folder)[0]}")
        self.store.fs.delete(self.store._path(folder), True)

    def forget(self, table: str, folders: list[str]) -> None:
        """Leave folders out of a table, whose rows others have taken over."""
        self.staged[table] = [f for f in self._folders(table) if f not in set(folders)]

    def insert(self, table: str, rows: DataFrame, key: str | None = None) -> None:
        """Append rows; with `key`, a null, repeated or known key refuses them all."""
        known = table in self.staged or table in self.held
        if key:
            bad = rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
            if not bad.isEmpty() or (known and not rows.join(self._current(table), key, "left_semi").isEmpty()):
                self.abort()
                raise ConflictError(f"{table}.{key} is not unique")
        self.append(table, rows)

    def update(self, table: str, where: Column, values: dict[str, Column]) -> None:
        """Set columns where the condition holds; new columns are added, null elsewhere."""
        rows = self._current(table)
        hit = F.coalesce(where, F.lit(False))
        self.replace(table, rows.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, v in values.items()}))

    def delete(self, table: str, where: Column, key: str | None = None, children: dict[str, str] | None = None) -> None:
        """Drop rows where the condition holds, and the rows of `children` (table: parent column) that belong to them."""
        rows = self._current(table)
        hit = F.coalesce(where, F.lit(False))
        gone = rows.where(hit).select(key) if key else None
        for child, parent in (children or {}).items():
            self.replace(child, self._current(child).join(gone.withColumnRenamed(key, parent), parent, "left_anti"))
        self.replace(table, rows.where(~hit))

    def prepare(self) -> None:
        if self.state != "pending":
            raise ConflictError(f"the transaction is {self.state}")
        self.state = "prepared"

    def commit(self) -> int:
        """Publish the staged tables as the next manifest."""
        if self.state == "pending":
            self.prepare()
        if self.state != "prepared":
            raise ConflictError(f"the transaction is {self.state}")
        number = self.base + 1
        try:
            stream = self.store.fs.create(self.store._path(f"manifests/{number:012d}.json"), False)
        except Exception as error:
            self.abort()
            raise ConflictError(f"version {number} exists already") from error
        stream.write(bytearray(json.dumps(self.held | self.staged).encode()))
        stream.close()
        self.state = "committed"
        for folder in self.passing:
            self.store.fs.delete(self.store._path(folder), True)
        return number

    def abort(self) -> None:
        for folder in self.new:
            self.store.fs.delete(self.store._path(folder), True)
        self.staged, self.new, self.state = {}, [], "aborted"


def scratch_store(spark: SparkSession) -> SnapshotStore:
    """A new store in the shared folder (spark.checkpoint.dir), or, on a local master only, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="fieldloom-")
    return SnapshotStore(spark, f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}")
