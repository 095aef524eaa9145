"""Versioned Parquet snapshots: a merge reads the last whole version and writes the next one beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


class Snapshots:
    """Versions ``v=1, v=2, ...`` under ``root``.

    A writer's rows go into a folder of its own, which is then renamed to the next version.  The rename fails if that
    version is there (a file system's promise for a folder that isn't empty, of HDFS and of local disks), so of two
    writers of one version the second gets a ``Conflict`` and nothing is replaced.  A crash leaves the last whole
    version, and a folder under ``_new`` that nothing reads.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._plainly = spark.sparkContext._gateway.new_array(rename, 1)
        self._plainly[0] = rename.NONE

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def read(self, version: int | None = None) -> DataFrame:
        """A version (the last by default) in today's schema; without any, an empty table."""
        held = self.versions()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version or held[-1]}")

    def write(self, df: DataFrame, base: int | None = None) -> int:
        """Write the version after ``base`` (by default the last one there is now, none is 0), and give its number."""
        version = ((self.versions() or [0])[-1] if base is None else base) + 1
        fresh = f"{self.root}/_new/{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        try:
            self._context.rename(self._path(fresh), self._path(f"{self.root}/v={version}"), self._plainly)
        except Py4JJavaError as e:
            self._fs.delete(self._path(fresh), True)
            if self._fs.exists(self._path(f"{self.root}/v={version}")):
                raise Conflict(f"another writer has made version {version} of {self.root}") from e
            raise
        return version

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5, touching: DataFrame | None = None) -> int:
        """Write what ``change`` makes of the last version.  Where another writer was faster, it is made again of what that one wrote.

        ``touching`` has the keys that ``change`` may add, replace or remove; here the whole table is written anyway.
        """
        for left in range(tries - 1, -1, -1):
            base = (self.versions() or [0])[-1]
            try:
                return self.write(change(self.read(base or None)), base)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 at least")

    def expire(self, keep: int = 2, older_than_seconds: float = 0) -> None:
        """Remove all but the last ``keep`` versions, if they were followed so long ago; readers of a version have that time."""
        held = self.versions()
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        for v, after in list(zip(held, held[1:], strict=False))[: max(0, len(held) - keep)]:
            followed = self._fs.getFileStatus(self._path(f"{self.root}/v={after}")).getModificationTime()
            if followed <= now - older_than_seconds * 1000:
                self._fs.delete(self._path(f"{self.root}/v={v}"), True)


class BucketedSnapshots(Snapshots):
    """A table in buckets by a hash of its key, of which an update reads and writes only those that it touches.

    A version is a list of each bucket's folder, which is committed as ``Snapshots`` commits a table; buckets that an
    update doesn't touch keep their folders.  The number of buckets is part of the table and can't be changed.
    """

    _LIST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: tuple[str, ...], buckets: int = 256):
        super().__init__(spark, root, schema)
        self.key, self.buckets = key, buckets
        self._lists = Snapshots(spark, f"{self.root}/_lists", self._LIST)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return self._lists.versions()

    def _folders(self, version: int) -> dict[int, str]:
        """A row for each bucket at most."""
        return {r.bucket: r.folder for r in self._lists.read(version).collect()} if version else {}

    def _table(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{folder}/bucket={b}" for b, folder in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """A version (the last by default) in today's schema; without any, an empty table."""
        held = self.versions()
        return self._table(self._folders(version or held[-1]) if held else {})

    def write(self, df: DataFrame, base: int | None = None) -> int:
        """Write a whole table as the version after ``base``."""
        base = (self.versions() or [0])[-1] if base is None else base
        return self._commit(df, {}, base)

    def _commit(self, df: DataFrame, kept: dict[int, str], base: int) -> int:
        folder = f"_data/{uuid.uuid4().hex}"
        # A bucket is one task's, so it is one file; AQE may join small ones, which partitionBy takes apart again.
        rows = df.withColumn("bucket", self._bucket()).repartition(min(self.buckets, 1024), "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        fresh = {int(n.removeprefix("bucket=")): folder for n in names if n.startswith("bucket=")}
        listed = self.spark.createDataFrame(sorted((kept | fresh).items()), self._LIST).coalesce(1)
        try:
            return self._lists.write(listed, base)
        except Conflict:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5, touching: DataFrame | None = None) -> int:
        """As ``Snapshots.update``; with ``touching`` (which has the key columns) ``change`` is given the rows of the touched buckets alone, and may give rows of these alone."""
        touched = range(self.buckets) if touching is None else [r[0] for r in touching.select(self._bucket()).distinct().collect()]
        for left in range(tries - 1, -1, -1):
            base = (self.versions() or [0])[-1]
            folders = self._folders(base)
            own = {b: f for b, f in folders.items() if b in set(touched)}
            try:
                return self._commit(change(self._table(own)), {b: f for b, f in folders.items() if b not in own}, base)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 at least")

    def expire(self, keep: int = 2, older_than_seconds: float = 0) -> None:
        """Forget old versions as ``Snapshots.expire`` does, and remove the folders of buckets that no other version has."""
        before = self.versions()
        named = {v: self._folders(v) for v in before}
        self._lists.expire(keep, older_than_seconds)
        left = {x for v in self.versions() for x in named.get(v, self._folders(v)).items()}
        for bucket, folder in {x for v in before for x in named[v].items()} - left:
            self._fs.delete(self._path(f"{self.root}/{folder}/bucket={bucket}"), True)
