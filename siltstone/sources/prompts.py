"""Prompt templates kept as files."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

from siltstone.functions import text


def load(spark: SparkSession, root: str, name: str) -> str:
    """Text of ``name.md`` below ``root``, else of ``name.txt``; nothing where neither is there or can be read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for ending in (".md", ".txt"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}{ending}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            rows = spark.read.format("text").option("wholetext", True).load(path.toString()).collect()  # one file
            return rows[0].value if rows else ""
    return ""


def filled(spark: SparkSession, root: str, name: str, values: dict[str, Column]) -> Column:
    """The template with its values; see ``text.substitute``."""
    return text.substitute(load(spark, root, name), values)
