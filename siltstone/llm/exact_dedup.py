"""Exact duplicates by a content sort.

Sampled splitters deal the texts out by range, an external sort inside each range puts equal texts next to each other,
and each text is compared in full with its neighbour.  The range key is (first characters, 64-bit hash, id) and not the
text alone: the sampled splitters stay small, and a group of copies of any size spreads over many ranges.  Runs that
touch the edge of a range (two for each range at most) are put together by comparing their full texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import lean, shuffle_partitions, staged

HEAD = 16  # characters of a text in its range key

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("keep_local", pa.int64()), ("size_local", pa.int64()), ("last", pa.bool_()), ("text_sha256", pa.string()), ("edge_text", pa.string())])
_DDL = "doc_id long, part int, run long, keep_local long, size_local long, last boolean, text_sha256 string, edge_text string"


def _rows(ids: pa.Array, starts: np.ndarray, texts: pa.Array, part: int, first_run: int, edge: bool) -> pa.RecordBatch:
    """Rows of whole runs; ``starts`` are their first rows, ``texts`` one text for each."""
    sizes = np.diff(np.append(starts, len(ids)))
    ends = np.cumsum(sizes) - 1
    last = np.zeros(len(ids), bool)
    last[ends] = True
    which = np.repeat(np.arange(len(starts)), sizes)
    sha = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.binary())], pa.string())
    shown = pa.array([None] * (len(ids) - 1) + [texts[0].as_py()], pa.string()) if edge else pa.nulls(len(ids), pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), part, np.int32)), pa.array(first_run + which), ids.take(pa.array(np.repeat(ends, sizes))), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(last), sha.take(pa.array(which)), shown], schema=_SCHEMA)


def _runs(batches):
    """Over rows sorted by text and id: the run, its last id and its size for each row.  Only the ids of the run that is still open are held."""
    part = TaskContext.get().partitionId()
    run, open_ids, open_text = 0, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0), batch.column(1)
        new = np.ones(len(ids), bool)
        new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        new[0] = open_text is None or texts[0].as_py() != open_text
        starts = np.flatnonzero(new)
        if not len(starts):
            open_ids.append(ids)
            continue
        if starts[0]:
            open_ids.append(ids.slice(0, starts[0]))
        if open_text is not None:
            yield _rows(pa.concat_arrays(open_ids), np.zeros(1, np.int64), pa.array([open_text], pa.string()), part, run, run == 0)
            run += 1
        at = 0
        if run == 0 and len(starts) > 1:
            yield _rows(ids.slice(0, starts[1]), np.zeros(1, np.int64), texts.slice(0, 1), part, 0, True)
            run, at = 1, 1
        whole = starts[at:-1]
        if len(whole):
            base, end = whole[0], starts[-1]
            yield _rows(ids.slice(base, end - base), whole - base, texts.take(pa.array(whole)), part, run, False)
            run += len(whole)
        open_ids, open_text = [ids.slice(starts[-1])], texts[int(starts[-1])].as_py()
    if open_text is not None:
        yield _rows(pa.concat_arrays(open_ids), np.zeros(1, np.int64), pa.array([open_text], pa.string()), part, run, True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "min", partitions: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``normalise`` maps the text column before it is compared (default: no change); ``keep`` is ``min`` or ``max`` and
    says which id of a group of equal texts stays.

    Null texts count as empty, and empty texts are equal.  Null ids never stay while another id of the group can; a
    group of null ids only has a null keep_id.  Of repeated rows (same id and text) all are returned and one is kept.
    Other columns are not looked at, so their names can't clash.  An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep: {keep}")
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("h"))
    by_id = F.col("doc_id").asc_nulls_first() if keep == "max" else F.col("doc_id").desc_nulls_first()
    n = partitions or shuffle_partitions(docs.sparkSession)
    dealt = d.repartitionByRange(n, F.col("head").asc(), F.col("h").asc(), by_id).sortWithinPartitions("head", "h", "text", by_id)
    t = staged(dealt.select("doc_id", "text").mapInArrow(lean(_runs), _DDL), "exact")
    most = F.max if keep == "max" else F.min
    same = Window.partitionBy("edge_text")
    # Two rows for each range at most, of four numbers each: bounded by the number of ranges, not by the rows.
    edges = t.filter("edge_text is not null").select("part", "run", most("keep_local").over(same).alias("edge_keep"), F.sum("size_local").over(same).alias("edge_size"))
    return (
        t.drop("edge_text")
        .join(F.broadcast(edges), ["part", "run"], "left")
        .select(
            "doc_id",
            F.coalesce("edge_keep", "keep_local").alias("keep_id"),
            F.coalesce("edge_size", "size_local").alias("group_size"),
            (F.col("last") & F.col("keep_local").eqNullSafe(F.coalesce("edge_keep", "keep_local"))).alias("kept"),
            "text_sha256",
        )
    )


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, dropped ones too; null and empty texts are equal; of repeated rows one is kept, and a null id is the smallest; an empty table gives no rows."""
    from siltstone.llm.common import table

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")
