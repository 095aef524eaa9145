"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.staging import shared_root, staged  # noqa: F401  used through this module


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether an id (null counts as one) is there more than once; no text is moved."""
    return bool(docs.groupBy(F.col(id_col).cast("long")).count().filter("count > 1").limit(1).count())


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones and one row for each id and text.

    Different texts under one id (null counts as an id) all stay.  Where ids don't repeat no text is moved.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.distinct() if ids_repeat(d) else d


def text_slices(batch: pa.RecordBatch, column: int, most: int):
    """Cut a batch into runs of rows that hold about ``most`` bytes of text (one row at least)."""
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    width = np.dtype(np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)
    off = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + n + 1]
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def lean(run):
    """A task function after which its worker, which lives on, gives free memory back.

    Arrow takes its memory from the system then, so that what one task has freed isn't kept beside what the next needs.
    """

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        ctypes.CDLL(None).malloc_trim(0)

    return task


def byte_texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def join_counted(rows: DataFrame, named: DataFrame, key: str, most_hot: int = 1_000_000) -> DataFrame:
    """``rows`` with the columns of ``named``, which has one row for each key and how many ``rows`` it has as ``n``.

    Hot keys (over a thousand rows, and over the ``most_hot``-th part of all rows, so there are at most so many) are
    sent to all executors, and their rows stay where they are; the others are dealt out by key.  ``named`` is read
    several times and should be staged; a count that is too high does no harm.
    """
    total, top = named.agg(F.sum("n"), F.max("n")).first()
    limit = max(1000, (total or 0) // most_hot)
    if (top or 0) <= limit:
        return rows.join(named.drop("n"), key)
    hot = F.broadcast(named.filter(F.col("n") > limit).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(named.filter(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node that can be reached.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) on staged tables until the edges stay the same.
    Minima come from partial aggregates and are joined back, those of stars with very many leaves by broadcast, so such
    a star isn't gathered anywhere.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), staged(low, label), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        keep = low.select("u", F.col("m").alias("v"))
        e = staged(small.unionByName(keep).filter("u <> v").distinct(), label)
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
