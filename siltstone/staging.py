"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own is used only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read of files, not a re-run of what made them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/siltstone-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Remove all tables that this application has staged; what was made from them can't be read afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(p), True)
    return len(paths)


class Growing:
    """A table that grows by whole tables.  Reading it is one scan, however many were added."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.spark, self.schema, self.parts = spark, schema, 0
        self.path = f"{shared_root(spark).rstrip('/')}/siltstone-{label}-{uuid.uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows, and give them as they are then."""
        path = f"{self.path}/part{self.parts:06d}"
        df.write.option("compression", "zstd").parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
