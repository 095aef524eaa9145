"""An exact index for nearest neighbours: cells around centroids, and triangle bounds that leave cells out.

Every vector lies in the cell of its nearest centroid, and a cell knows how far its farthest one is from there.  A query
looks into its nearest cells first, until they hold k vectors; the k-th distance found there rules out every cell whose
centroid is farther away than that and the cell's radius together.  Nothing is approximate: a cell is left out only if
none of its vectors can be among the k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.vectors import _near
from siltstone.staging import staged

SAMPLE = 20_000  # vectors at most from which centroids are found
CELLS = 1024  # centroids at most
ROWS = 20_000  # vectors of a cell, and queries, that meet in one task's group
SLACK = 4e-6  # distances are rounded to six places


@dataclass(frozen=True)
class VectorIndex:
    """``items``: id, v, cell, bucket; ``cells``: cell, n, radius, buckets (a row for each centroid at most)."""

    items: DataFrame
    cells: DataFrame
    centroids: np.ndarray
    metric: str


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the triangle inequality is used on: of length one for cosine distances."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """From each row to each centre, measured directly where the short form would lose digits."""
    out = np.empty((len(x), len(centers)))
    for i in range(0, len(centers), 16):
        part = centers[i : i + 16]
        out[:, i : i + 16] = np.sqrt(((x[:, None, :] - part[None]) ** 2).sum(2))
    return out


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centers = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _assign(held, metric: str):
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("far", pa.float64())])

    def run(batches):
        centers = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                far = _distances(_unit(_matrix(part.column(1)), metric), centers)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(schema.types[1]), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], schema=schema)

    return run


def build(collection: DataFrame, metric: str = "l2", item_id: str = "id", vector_col: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Index every row with a vector (all of one length).

    Centroids, at most ``cells`` and about the root of the row count, are found on the driver from at most ``sample``
    vectors, those with the smallest hashes of their ids.  Null vectors are left out; repeated ids count as often as they
    come; an empty collection gives an index of nothing.
    """
    spark = collection.sparkSession
    rows = staged(collection.filter(F.col(vector_col).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = _unit(np.array([r.v for r in some], np.float64), metric) if some else np.zeros((0, 1))
    centers = _centroids(x, max(1, min(cells, int(n**0.5), len(x)))) if len(x) else np.zeros((0, 1))
    assigned = staged(rows.mapInArrow(_assign(spark.sparkContext.broadcast(centers), metric), "id long, v array<double>, cell int, far double"), "assigned")
    known = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    known = staged(known.withColumn("buckets", F.ceil(F.col("n") / ROWS).cast("int")), "cells")
    items = assigned.join(known.select("cell", "buckets"), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int").alias("bucket"))
    return VectorIndex(staged(items, "items"), known, centers, metric)


_PAIR_DDL = "query_id long, v array<double>, cell int"


def _choose(held, metric: str, k: int, second: bool):
    """(query, cell) pairs: the nearest cells that hold k vectors, or, with a bound for each query, the others that it doesn't rule out."""
    schema = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])

    def run(batches):
        centers, number, counts, radius = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = _distances(_unit(_matrix(part.column(1)), metric), centers)
                order = np.argsort(far, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                if second:
                    bound = part.column(2).to_numpy(zero_copy_only=False)[:, None]  # NaN: fewer than k are there at all
                    reach = (np.sqrt(2 * np.maximum(bound + SLACK, 0)) if metric == "cosine" else bound) + SLACK
                    first = ~first & ~(far - radius > reach)
                row, cell = np.nonzero(first)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(number[cell])], schema=schema)

    return run


def _meet(k: int, metric: str):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        q, x = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks())
        qid, ids, out = left["query_id"].to_numpy(), right["id"].to_numpy(), []
        tile = max(1, (1 << 22) // len(ids))
        for at in range(0, len(q), tile):
            out += _near(q[at : at + tile], x, ids, k, metric)
        return pa.table([np.repeat(qid, [len(i) for i, _ in out]), np.concatenate([i for i, _ in out]), np.concatenate([d for _, d in out])], schema=schema)

    return run


def _visit(index: VectorIndex, pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each bucket of the cells it looks into.  Cells of many vectors or many queries meet in several groups."""
    asked = staged(pairs.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")).join(index.cells.select("cell", "buckets"), "cell"), "asked")
    key = ["cell", "bucket", "block"]
    q = pairs.join(asked, "cell").select("query_id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"))
    x = index.items.join(asked.select("cell", "blocks"), "cell").select("id", "v", "cell", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(_meet(k, index.metric), "query_id long, id long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """What ``vectors.top_k`` gives (``query_id, id, distance, rank``), and the (query_id, cell) pairs that were looked into.

    Queries without a vector have no neighbours; ``query_id`` is taken to be unique.
    """
    spark = queries.sparkSession
    known = index.cells.orderBy("cell").collect()  # one row for each centroid at most
    rows = staged(queries.filter(F.col(vector_col).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")), "queries")
    if not known:
        none = "query_id long, id long, distance double, rank int"
        return spark.createDataFrame([], none), spark.createDataFrame([], "query_id long, cell int")
    number = np.array([r.cell for r in known], np.int32)
    held = spark.sparkContext.broadcast((index.centroids[number], number, np.array([r.n for r in known], np.int64), np.array([r.radius for r in known])))
    near = staged(rows.mapInArrow(_choose(held, index.metric, k, False), _PAIR_DDL), "near")
    first = staged(_visit(index, near, k), "first")
    bound = first.transform(_best, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("bound"))
    other = rows.join(bound, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("nan"))).alias("bound"))
    rest = staged(other.mapInArrow(_choose(held, index.metric, k, True), _PAIR_DDL), "rest")
    best = _best(first.unionByName(_visit(index, rest, k)), k)
    return best.select("query_id", "id", "distance", "rank"), near.select("query_id", "cell").unionByName(rest.select("query_id", "cell"))
