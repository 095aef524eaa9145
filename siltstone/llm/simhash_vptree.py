"""Near-duplicates: SimHash fingerprints joined exactly through vantage-point trees.

A metric tree on all 64 bits prunes little at four bits, since random fingerprints lie at about 32 from each other.
The fingerprint is therefore cut into blocks (three by default).  Two fingerprints that differ in at most ``d`` bits
differ in at most ``d // blocks`` bits of some block, so each block gets a vantage-point tree over its own Hamming
distance with that smaller radius.  Trees are built from a bounded sample of distinct fingerprints; every distinct
fingerprint goes to the shards (leaves) whose region its ball meets, and inside a shard it is compared over all 64
bits, again only with those that the triangle bound round the shard's own vantage point lets through.  Nothing is
approximate: any two fingerprints within the distance meet in some shard.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, connected_components, join_counted, lean, staged, table, text_slices

BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash over word shingles: ASCII case folded, words cut at ASCII white space, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(line, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        cut = map(line.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
        digests = b"".join(map(xxhash.xxh64_digest, cut, repeat(42)))
    n = len(digests) // 8
    count = np.zeros(BITS, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 15):
        count += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 8 << 20):
                fps = np.array([fingerprint(t, shingle) for t in byte_texts(part, 1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], schema=schema)

    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for each row; the fingerprint's bits are held as a signed long.  Null text counts as empty: fingerprint zero."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(_fingerprints(shingle)), "doc_id long, fp long")


class VantageTree:
    """A complete binary tree of vantage points; node i has children 2i+1 (distance at most ``mu``) and 2i+2."""

    def __init__(self, sample: np.ndarray, levels: int, mask: int, radius: int):
        self.levels, self.mask, self.radius = levels, np.uint64(mask), radius
        nodes = (1 << levels) - 1
        self.vantage, self.mu = np.zeros(nodes, np.uint64), np.full(nodes, BITS, np.int16)
        rng = np.random.default_rng(20231)
        groups = {0: np.unique(sample & self.mask)}
        for node in range(nodes):
            own = groups.pop(node, None)
            if own is None or not len(own):
                continue
            # Of a few points, the one whose distances spread most: fewer balls then cross the boundary.
            tried = own[rng.integers(0, len(own), 4)]
            far = [np.bitwise_count(own ^ v) for v in tried]
            best = int(np.argmax([f.std() for f in far]))
            d = far[best]
            heads = np.cumsum(np.bincount(d, minlength=BITS + 1))
            mu = int(np.argmin(np.abs(heads - len(own) / 2)))
            self.vantage[node], self.mu[node] = tried[best], mu
            groups[2 * node + 1], groups[2 * node + 2] = own[d <= mu], own[d > mu]

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and shards: of a pair within the radius both go to some common shard.

        The side that holds distances up to mu needs no visitors; those within the radius below mu visit the other.
        """
        x, row, node = fps & self.mask, np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.levels):
            d, mu = np.bitwise_count(x[row] ^ self.vantage[node]).astype(np.int16), self.mu[node]
            near, over = d <= mu, d > mu - self.radius
            row, node = np.concatenate([row[near], row[over]]), np.concatenate([2 * node[near] + 1, 2 * node[over] + 2])
        return row, node - ((1 << self.levels) - 1)


def block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def shard_links(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard as stars (least fingerprint of a connected group, each other one), as signed longs.

    Groups are grown from point to point; whatever is in a group is looked at no more, so a dense cluster of n
    fingerprints takes some multiple of n comparisons and not n squared.
    """
    pts = np.unique(fps)
    d = np.bitwise_count(pts ^ pts[0]).astype(np.int64) if len(pts) else np.zeros(0, np.int64)
    order = np.argsort(d, kind="stable")
    pts, d = pts[order], d[order]
    marks = np.arange(BITS + 2)
    heads, left, gone, at = np.searchsorted(d, marks), np.ones(len(pts), bool), 0, 0
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while at < len(pts):
        if not left[at]:
            at += 1
            continue
        left[at] = False
        gone += 1
        group, todo = [pts[at : at + 1]], [(pts[at], d[at])]
        while todo:
            x, dx = todo.pop()
            # The triangle bound: others lie within max_distance of this one's distance to the vantage point.
            lo, hi = heads[max(0, dx - max_distance)], heads[min(BITS + 1, dx + max_distance + 1)]
            hits = lo + np.flatnonzero((np.bitwise_count(pts[lo:hi] ^ x) <= max_distance) & left[lo:hi])
            if len(hits):
                left[hits] = False
                gone += len(hits)
                group.append(pts[hits])
                todo += zip(pts[hits], d[hits], strict=True)
            if gone * 2 > len(pts) > 64:
                pts, d = pts[left], d[left]
                heads, left, gone, at = np.searchsorted(d, marks), np.ones(len(pts), bool), 0, 0
        members = np.concatenate(group).view(np.int64)
        if len(members) > 1:
            root = members.min()
            b.append(members[members != root])
            a.append(np.full(len(members) - 1, root))
    return np.concatenate(a), np.concatenate(b)


def _to_shards(trees):
    schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        built = trees.value
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(built):
                row, shard = tree.shards(fps)
                yield pa.RecordBatch.from_arrays([pa.array(shard | (k << 40)), pa.array(fps[row].view(np.int64))], schema=schema)

    return run


def nested_links(fps: np.ndarray, max_distance: int, mask: int, radius: int, shard_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard of any size: a large one has a tree of its own, and its leaves are compared one by one."""
    pts = np.unique(fps)
    levels = max(0, int(np.ceil(np.log2(max(1, len(pts)) / shard_size))))
    if levels < 2:
        return shard_links(pts, max_distance)
    row, leaf = VantageTree(pts, levels, mask, radius).shards(pts)
    row = row[np.argsort(leaf, kind="stable")]
    cuts = np.cumsum(np.bincount(leaf, minlength=1 << levels))
    parts = [shard_links(pts[row[a:b]], max_distance) for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True) if b - a > 1]
    return tuple(np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _join_shards(max_distance: int, masks: list[int], shard_size: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(held, shard):
        return nested_links(np.concatenate(held), max_distance, masks[int(shard) >> 40], max_distance // len(masks), shard_size)

    def run(batches):
        held, shard = [], None
        for batch in batches:
            key, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if key[lo] != shard:
                    if held:
                        a, b = links(held, shard)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                    held, shard = [], key[lo]
                held.append(fps[lo:hi])
        if held:
            a, b = links(held, shard)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def near_links(fps: DataFrame, max_distance: int = 4, blocks: int = 3, shard_size: int = 1024, sample_size: int = 1 << 18) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``max_distance`` bits.

    Not all pairs: each shard gives a star for each of its connected groups, which has the same components.
    ``sample_size`` bounds the fingerprints from which the trees are built (and so the broadcast trees, 10 bytes a
    node); it does not bound what is joined.  Shards that are larger than ``shard_size`` because the sample can't tell
    more of them apart are split further where they are compared, by trees over all of their own fingerprints.
    """
    spark = fps.sparkSession
    n = fps.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / shard_size))))
    size = min(sample_size, 16 << levels)
    levels = min(levels, int(np.log2(sample_size)) - 4)
    drawn = fps.select("fp").orderBy(F.xxhash64(F.col("fp").cast("string"))).limit(size).collect() if levels else []
    sample = np.array([r[0] for r in drawn], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree(sample, levels, m, max_distance // blocks) for m in block_masks(blocks)])
    dealt = fps.select("fp").mapInArrow(lean(_to_shards(trees)), "shard long, fp long").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lean(_join_shards(max_distance, block_masks(blocks), shard_size)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, blocks: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id`` (the least id that links reach, its own included).

    Rows with equal fingerprints are one class from the start, so copies are never paired.  Null and empty texts have
    fingerprint zero and link like others.  A null id is in a component but never names it, unless all ids there are
    null.  Repeated rows are returned as often as they come; other columns are not read.  Empty tables give no rows.
    """
    fps = staged(simhash(docs, id_col, text_col, shingle), "simhash")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    comp = connected_components(near_links(classes, max_distance, blocks), "near")
    named = staged(comp.join(classes, comp.node == classes.fp).select("node", "root", "rep"), "members")
    least = staged(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "least")
    of_fp = join_counted(named.select("node", "root"), least, "root").select(F.col("node").alias("fp"), "component_id")
    of_class = staged(classes.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n"), "named")
    return join_counted(fps, of_class, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null and empty texts have fingerprint zero; an empty table gives no rows."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
