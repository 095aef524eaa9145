"""Benchmark decontamination: a broadcast hash set of the items' n-grams against every document's word windows.

Hits of the hash set are verified word by word.  The set grows with the benchmark and never with the documents; items
beyond ``block_words`` words go in further blocks, one pass over the documents each, and the hits of all blocks are
put together by document.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, lean, staged, table, text_slices

BLOCK_WORDS = 400_000  # words of items in one broadcast: some 250 MB on the driver and in a worker, 50 MB on the way

# ASCII letters folded, digits kept, every other ASCII byte a space; bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSet:
    """Windows of ``n`` words of some items (the whole item where it has fewer) as a sorted hash table."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set[int]]] = {}
        self.names = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(k)
        self.by_size = []
        for size, windows in sorted(found.items()):
            rows = np.array(list(windows), np.int64).reshape(-1, size)
            owners = [np.array(sorted(o), np.int64) for o in windows.values()]
            h = self._hash(rows.T)
            order = np.argsort(h, kind="stable")
            self.by_size.append((size, h[order], rows[order], [owners[i] for i in order]))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = h * _BASE + c.astype(np.uint64)
            h ^= h >> np.uint64(31)
        return h

    def hits(self, ids: np.ndarray, row: np.ndarray):
        """Occurrences in the word ids of several documents put end to end (``row``: the document of each): (start, size, owners)."""
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for size, hashes, windows, owners in self.by_size:
            last = len(ids) - size + 1
            if last <= 0:
                continue
            at = np.flatnonzero((known[size:] - known[:last] == size) & (row[size - 1 :] == row[:last]))
            h = self._hash([ids[at + k] for k in range(size)]) if len(at) else np.zeros(0, np.uint64)
            lo = np.searchsorted(hashes, h)
            while len(at):  # equal hashes of different windows lie next to each other
                inside = lo < len(hashes)
                at, h, lo = at[inside], h[inside], lo[inside]
                same = hashes[lo] == h
                at, h, lo = at[same], h[same], lo[same]
                if not len(at):
                    break
                true = np.ones(len(at), bool)
                for k in range(size):
                    true &= ids[at + k] == windows[lo, k]
                for a, w in zip(at[true].tolist(), lo[true].tolist(), strict=True):
                    yield a, size, owners[w]
                at, h, lo = at[~true], h[~true], lo[~true] + 1


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_DDL = "doc_id long, row_key long, n_words long, spans array<long>, items array<string>"


def _scan(held):
    def run(batches):
        windows = held.value
        get = windows.vocabulary.get
        for whole in batches:
            for batch in text_slices(whole, 2, 4 << 20):
                words = [words_of(t) for t in byte_texts(batch, 2)]
                sizes = np.array([len(w) for w in words], np.int64)
                total = int(sizes.sum())
                ids = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int64, total)
                del words
                row = np.repeat(np.arange(len(sizes)), sizes)
                begins = np.cumsum(sizes) - sizes
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for at, size, owners in windows.hits(ids, row):
                    r = int(row[at])
                    spans.setdefault(r, []).append((at - int(begins[r]), at - int(begins[r]) + size))
                    items.setdefault(r, set()).update(owners.tolist())
                n = len(sizes)
                flat = [list(chain.from_iterable(_union(spans[r]))) if r in spans else [] for r in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(windows.names[i] for i in items[r]) if r in items else [] for r in range(n)], pa.list_(pa.string()))], schema=_SCHEMA)

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, n: int):
    """The items in blocks of at most ``block_words`` words; a longer item comes in pieces that overlap by a window less one word."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    most = max(block_words, 2 * n)
    for r in rows.toLocalIterator():
        words = words_of(r.t.encode())
        for at in range(0, max(1, len(words) - n + 1), most - n + 1):
            piece = words[at : at + most]
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((r.i, b" ".join(piece).decode()))
            size += len(piece)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, row_key (xxhash64 of the text), n_words, spans (flat word starts and ends of what is hit), items (sorted ids), n_hit, contaminated``.

    Words are ASCII case folded and cut at all other ASCII signs.  A window is ``n`` consecutive words of an item; an
    item of fewer words, but not none, is one window.  A word inside any occurrence of a window is hit.

    Null texts have no words, in documents and items; items without an id are left out.  Repeated items count once;
    repeated documents each get their row.  Extra columns of either table aren't read.  With an empty benchmark nothing
    is hit; an empty table of documents gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_words, n)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = d.mapInArrow(lean(_scan(sc.broadcast(WindowSet(first, n)))), _DDL)
    else:
        # One block is out at a time: its hits are written, then it is taken back from the executors.
        whole, hits = None, None
        for block in chain([first, second], blocks):
            held = sc.broadcast(WindowSet(block, n))
            one = d.mapInArrow(lean(_scan(held)), _DDL)
            one = staged(one if whole is None else one.filter("size(spans) > 0"), "hits")
            held.destroy()
            whole = one if whole is None else whole
            one = one.filter("size(spans) > 0").dropDuplicates(["doc_id", "row_key"])  # repeated rows are hit alike
            hits = one if hits is None else hits.unionByName(one)
        merged = hits.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = merged.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.expr(_MERGED).alias("s"), F.col("items").alias("i"))
        rows = whole.select("doc_id", "row_key", "n_words")
        found = rows.join(merged, rows.doc_id.eqNullSafe(merged["__id"]) & (rows.row_key == merged["__key"]), "left")
        found = found.select("doc_id", "row_key", "n_words", F.coalesce("s", F.array().cast("array<bigint>")).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "row_key", "n_words", "spans", "items", hit.alias("n_hit")).withColumn("contaminated", F.col("n_hit") > 0)


#: Spans of several blocks as one flat list without overlaps.
_MERGED = """
flatten(transform(aggregate(
  array_sort(transform(filter(sequence(0, greatest(size(spans) - 1, 0)), i -> i % 2 = 0 and i + 1 < size(spans)), i -> struct(spans[i] as lo, spans[i + 1] as hi))),
  cast(array() as array<struct<lo:bigint,hi:bigint>>),
  (a, x) -> if(size(a) > 0 and x.lo <= a[size(a) - 1].hi,
    concat(slice(a, 1, size(a) - 1), array(named_struct('lo', a[size(a) - 1].lo, 'hi', greatest(a[size(a) - 1].hi, x.hi)))),
    concat(a, array(named_struct('lo', x.lo, 'hi', x.hi))))), s -> array(s.lo, s.hi)))
"""


OP2_SQL = """
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM bw, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, i, n, array_to_string(d.w[i : i + n - 1], ' ') AS g FROM dw d, lens, unnest(generate_series(1, len(d.w) - n + 1)) AS t(i)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item FROM occ o JOIN win ON o.n = win.n AND o.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(generate_series(h.i, h.i + h.n - 1)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null and empty texts have no words and aren't contaminated; items of one id count once; with an empty benchmark nothing is hit; an empty table gives no rows."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
