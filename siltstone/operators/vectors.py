"""Chunk vectors: embedding, keyed merge, exact top-k search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20  # query vectors in one broadcast
TILE = 1 << 22  # distances held at a time


def hashing_embedder(dims: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(df: DataFrame, text_col: str = "page_content", out_col: str = "embedding", embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    model = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(model(x.tolist())))

    return df.withColumn(out_col, run(F.col(text_col)))


def upsert(collection: DataFrame, incoming: DataFrame, key: str = "chunk_id", ordinal: str | None = None, delete_stale: str | None = None) -> DataFrame:
    """Keyed merge, the last write of a key wins (by ``ordinal`` where keys repeat).

    With ``delete_stale`` (a document column) the old chunks of every document that comes again go first, so that a
    document that shrank leaves none behind.
    """
    if ordinal:
        rest = [c for c in incoming.columns if c != key]
        incoming = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(key, "r.*").drop(ordinal)
    old = collection.join(incoming.select(key), key, "left_anti")
    if delete_stale:
        old = old.join(incoming.select(delete_stale).distinct(), delete_stale, "left_anti")
    return old.unionByName(incoming, allowMissingColumns=True)


def _near(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k nearest rows of ``x`` for each row of ``q``: (ids, distances rounded to six places), ties to the smaller id.

    The expanded square only picks rows; whatever may be among the k is measured directly, so results don't depend on
    how rows are batched.
    """
    if metric == "cosine":
        q, x = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
        rough = 1 - q @ x.T
        slack = np.full(len(q), 2e-6)
    else:
        qn, xn = (q**2).sum(1), (x**2).sum(1)
        rough = np.sqrt(np.maximum(qn[:, None] + xn[None] - 2 * q @ x.T, 0))
        slack = 2e-6 + 1e-7 * np.sqrt(qn + xn.max())
    out = []
    for i in range(len(q)):
        last = np.partition(rough[i], k - 1)[k - 1] if len(x) > k else np.inf
        at = np.flatnonzero(~(rough[i] > last + 2 * slack[i]))
        d = 1 - (x[at] * q[i]).sum(1) if metric == "cosine" else np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        d = np.round(d, 6) + 0.0  # no negative zero
        by = np.lexsort((ids[at], d))[:k]
        out.append((ids[at][by], d[by]))
    return out


def _search(held, k: int, metric: str):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        qid, q = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            if not len(ids):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            tile = max(1, TILE // len(ids))
            for at in range(0, len(q), tile):
                for i, (new_ids, new_d) in enumerate(_near(q[at : at + tile], x, ids, k, metric), at):
                    both, d = np.concatenate([best[i][0], new_ids]), np.concatenate([best[i][1], new_d])
                    by = np.lexsort((both, d))[:k]
                    best[i] = both[by], d[by]
        counts = [len(b[0]) for b in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, counts)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], schema=schema)

    return run


def top_k(queries: DataFrame, collection: DataFrame, k: int = 5, metric: str = "l2", query_id: str = "query_id", item_id: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Exact nearest neighbours: ``query_id, id, distance (rounded to six places), rank``; ties go to the smaller id.
    A repeated id counts as often as it comes.

    Query vectors go out in blocks of bounded size, one pass over the collection each.  A task keeps k candidates for
    each query, so the shuffle holds k rows for each query and task and never all pairs.
    """
    spark = collection.sparkSession
    items = collection.filter(F.col(vector_col).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(vector_col).alias("v"))
    found, block, size = None, [], 0

    def search(rows):
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
        return items.mapInArrow(_search(held, k, metric), "query_id long, id long, distance double")

    for row in queries.filter(F.col(vector_col).isNotNull()).select(F.col(query_id).cast("long"), vector_col).toLocalIterator():
        if block and size + 8 * len(row[1]) > BLOCK_BYTES:
            found = search(block) if found is None else found.unionByName(search(block))
            block, size = [], 0
        block.append(row)
        size += 8 * len(row[1])
    if block:
        found = search(block) if found is None else found.unionByName(search(block))
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")  # cut to k in each task before it is dealt out
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def add_document(collection: DataFrame, texts: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, key: str = "chunk_id") -> DataFrame:
    """The collection with ``texts`` (key, page_content and whatever metadata) embedded and merged by key; blank texts aren't added."""
    fresh = texts.filter(F.coalesce(F.trim("page_content"), F.lit("")) != "")
    return upsert(collection, embed(fresh, embedder=embedder), key)


def get(collection: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk with its citation filled in."""
    return collection.filter(F.col("chunk_id") == chunk_id).withColumn("citation_url", F.coalesce("source_url", "url"))
