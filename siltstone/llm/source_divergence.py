"""How the sources of a language differ in their words, from mergeable radix tries.

Each task counts the terms of its documents in one byte trie for each language.  A trie's edges hold the bytes that its
terms share, and its leaves hold a counter for each source.  What a trie holds comes out in the order of UTF-8, leaf by
leaf; leaves of all tasks are dealt out by sampled ranges of language and term, where equal ones lie side by side and
are added up in one pass.  A second pass along each range turns counters into shares, sums the divergence of every two
sources, and keeps each source's first candidates; as it goes by in the order of UTF-8, ties are in order too.
"""

from __future__ import annotations

import itertools
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import lean, shuffle_partitions, staged, table, text_slices

# Letters in lower case; every byte above ASCII is part of a term, all others part terms.
TERM_BYTES = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256)).lower()
SLICE = 8 << 20  # bytes of text counted together
LEAVES = 250_000  # of a task's tries; then they are written out and new ones begin
RANGE_ROWS = 1_000_000  # leaves in one range
CELLS = 1 << 19  # counters looked at together
SCALE = 1_000_000_000


class RadixTrie:
    """A number for each byte string.  A node is ``[label, children by first byte or None, number or -1]``."""

    def __init__(self):
        self.root = [b"", None, -1]

    def number(self, term: bytes, fresh: int) -> int:
        """The number of a term; one that isn't there gets ``fresh``."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node[1] is None:
                node[1] = {}
            child = node[1].get(term[at])
            if child is None:
                node[1][term[at]] = [term[at:], None, fresh]
                return fresh
            if term.startswith(child[0], at):
                at += len(child[0])
            else:  # the edge parts where the bytes differ
                label, same = child[0], 1
                while at + same < end and label[same] == term[at + same]:
                    same += 1
                child[0] = label[same:]
                child = node[1][term[at]] = [label[:same], {label[same]: child}, -1]
                at += same
            node = child
        if node[2] < 0:
            node[2] = fresh
        return node[2]

    def walk(self):
        """(term, number) in byte order."""
        stack = [(b"", self.root)]
        while stack:
            before, (label, children, number) = stack.pop()
            term = before + label
            if number >= 0:
                yield term, number
            if children:
                stack += [(term, children[b]) for b in sorted(children, reverse=True)]


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, code) of every term occurrence, and the terms by code."""
    col = texts.cast(pa.large_binary()).fill_null(b"")
    heads = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    clean = col.buffers()[2][int(heads[0]) : int(heads[-1])].to_pybytes().translate(TERM_BYTES) if col.buffers()[2] else b""
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer((heads - heads[0]).tobytes()), pa.py_buffer(clean)]))
    coded = split.flatten().dictionary_encode()
    names, codes = coded.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(col)), np.diff(np.asarray(split.offsets)))
    if b"" in names:
        some = codes != names.index(b"")
        row, codes = row[some], codes[some]
    return row, codes, names


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.cast(pa.large_string()).fill_null("").dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"


class Tries:
    """A task's tries, one for each language, and the counters of their leaves: (leaf, source, occurrences, documents)."""

    def __init__(self):
        self.tries: dict[str, RadixTrie] = {}
        self.sources: dict[str, int] = {}
        self.leaves, self.cells, self.held = 0, [], 0

    def _leaf(self, lang: str, term: bytes) -> int:
        number = self.tries.setdefault(lang, RadixTrie()).number(term, self.leaves)
        self.leaves += number == self.leaves
        return number

    def _put(self, *cells: np.ndarray) -> None:
        self.cells.append(np.stack(cells))
        self.held += self.cells[-1].shape[1]
        if self.held > 4 * LEAVES:
            self.cells = [self._summed()]
            self.held = self.cells[0].shape[1] // 2

    def _summed(self) -> np.ndarray:
        """Cells in the order of leaf and source, one for each."""
        leaf, source, counts, docs = np.concatenate(self.cells, axis=1)
        key = leaf * len(self.sources) + source
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        return np.stack([leaf[order][heads], source[order][heads], np.add.reduceat(counts[order], heads), np.add.reduceat(docs[order], heads)])

    def add(self, langs: pa.Array, sources: pa.Array, texts: pa.Array) -> None:
        """Count documents.  The root's leaf counts each source's documents."""
        lang, lang_names = _coded(langs)
        source, source_names = _coded(sources)
        numbers = np.array([self.sources.setdefault(s, len(self.sources)) for s in source_names], np.int64)
        source = numbers[source]
        known = len(self.sources)
        group, n = np.unique(lang * known + source, return_counts=True)
        self._put(np.array([self._leaf(lang_names[g // known], b"") for g in group.tolist()], np.int64), group % known, n, n)
        row, code, names = _terms(texts)
        if not len(code):
            return
        per_doc, n = np.unique(row * len(names) + code, return_counts=True)
        row, code = per_doc // len(names), per_doc % len(names)
        key = (lang[row] * len(names) + code) * known + source[row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        term, at = np.unique(key[heads] // known, return_inverse=True)
        leaf = np.array([self._leaf(lang_names[t // len(names)], names[t % len(names)]) for t in term.tolist()], np.int64)
        self._put(leaf[at], key[heads] % known, np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(key))))

    def flush(self):
        """All leaves in the order of language and term."""
        if not self.leaves:
            return
        leaf, source, counts, docs = self._summed()
        begins = np.searchsorted(leaf, np.arange(self.leaves + 1))
        docs, names = np.add.reduceat(docs, begins[:-1]), pa.array(list(self.sources), pa.string())
        for lang in sorted(self.tries):
            walked = self.tries[lang].walk()
            while rows := list(itertools.islice(walked, 20_000)):
                own = np.array([number for _, number in rows])
                sizes = begins[own + 1] - begins[own]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(offsets[-1]) + np.repeat(begins[own] - offsets[:-1], sizes)
                ends = pa.array(offsets.astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, names.take(pa.array(source[at]))), pa.ListArray.from_arrays(ends, pa.array(counts[at]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([term for term, _ in rows], pa.binary()), pa.array(docs[own]), *lists], schema=_LEAF)


def _count(batches):
    tries = Tries()
    for whole in batches:
        for batch in text_slices(whole, 2, SLICE):
            tries.add(batch.column(0), batch.column(1), batch.column(2))
            if tries.leaves > LEAVES:
                yield from tries.flush()
                tries = Tries()
    yield from tries.flush()


def _added(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one language and term, which lie side by side, as one row."""
    if batch.num_rows < 2:
        return batch
    fresh = np.array([True] * batch.num_rows)
    fresh[1:] = pc.or_(pc.not_equal(batch.column(0)[1:], batch.column(0)[:-1]), pc.not_equal(batch.column(1)[1:], batch.column(1)[:-1])).to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(fresh)
    sizes = np.asarray(pc.list_value_length(batch.column(3)))
    group = np.repeat(np.cumsum(fresh) - 1, sizes)
    coded = batch.column(3).flatten().dictionary_encode()
    key = group * max(1, len(coded.dictionary)) + np.asarray(coded.indices)
    cells, at = np.unique(key, return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, at, np.asarray(batch.column(4).flatten()))
    offsets = pa.array(np.searchsorted(cells // max(1, len(coded.dictionary)), np.arange(len(heads) + 1)).astype(np.int32))
    names = coded.dictionary.take(pa.array(cells % max(1, len(coded.dictionary))))
    rows = pa.array(heads)
    docs = np.add.reduceat(batch.column(2).to_numpy(), heads)
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(docs), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(counts))], schema=_LEAF)


_KEPT_DDL = "part_range int, " + _LEAF_DDL


def _merge(least: int):
    """Adds up leaves of one term, and lets through those in enough documents, and the roots."""

    def run(batches):
        part, held = TaskContext.get().partitionId(), None

        def kept(rows: pa.RecordBatch):
            rows = rows.filter(pc.or_(pc.greater_equal(rows.column(2), least), pc.equal(pc.binary_length(rows.column(1)), 0)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), *rows.columns], names=["part_range", *_LEAF.names])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, _LEAF.types, strict=True)], schema=_LEAF)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            batch = _added(batch)
            if batch.num_rows:
                held = batch.slice(batch.num_rows - 1)
                yield kept(batch.slice(0, batch.num_rows - 1))
        if held is not None:
            yield kept(held)

    return run


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), exactly at any size."""
    if not counts.size:
        return counts
    if int(counts.max()) + 2 > (1 << 63) // SCALE - 1:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 2) // total).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Language:
    """The leaves of one language in one range, as cells (term, source, count)."""

    def __init__(self, lang: str, top: int):
        self.lang, self.top, self.names, self.totals, self.kinds = lang, top, [], [], 0
        self.terms, self.rows, self.codes, self.counts = [], array("q"), array("q"), array("q")

    def head(self, source: str, total: int, kinds: int) -> None:
        self.names.append(source)
        self.totals.append(total)
        self.kinds = kinds

    def leaf(self, term: bytes, sources: list[str], counts: list[int]) -> None:
        if not self.terms:
            self.code = {s: i for i, s in enumerate(self.names)}
        self.rows.extend([len(self.terms)] * len(sources))
        self.terms.append(term)
        self.codes.extend([self.code[s] for s in sources])
        self.counts.extend(counts)

    def _dense(self, cells: tuple[np.ndarray, ...], low: int, high: int) -> np.ndarray:
        rows, codes, counts = cells
        a, b = np.searchsorted(rows, [low, high])
        out = np.zeros((high - low, len(self.names)), np.int64)
        out[rows[a:b] - low, codes[a:b]] = counts[a:b]
        return out

    def results(self):
        """(lang, source, part, item, value): sums of every two sources, and the candidates of each."""
        n, step = len(self.names), max(1, CELLS // len(self.names))
        cells = tuple(np.array(x, np.int64) for x in (self.rows, self.codes, self.counts))
        wide = any(t > 1 << 61 for t in (sum(self.totals), self.kinds))
        each = np.array([t + 2 * self.kinds for t in self.totals], object if wide else np.int64)
        whole = sum(self.totals) + 2 * self.kinds
        best: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
        for block in range(0, n, step):  # so many sources that their sums with all others fit
            sums = np.zeros((min(step, n - block), n), np.int64)
            for low in range(0, len(self.terms), step):
                high = min(len(self.terms), low + step)
                dense = self._dense(cells, low, high)
                p = shares(dense, each)
                for i in range(len(sums)):
                    sums[i] += divergence(p[:, block + i, None], p).sum(0)
                if block == 0:
                    q = shares(dense.sum(1), whole)
                    for s in range(n):
                        at = np.flatnonzero((dense[:, s] > 0) & (p[:, s] > q))
                        value = divergence(p[at, s], q[at])
                        first = np.argsort(-value, kind="stable")[: self.top]  # terms ascend, so ties are in order
                        best[s] = sorted(best[s] + [(int(value[j]), self.terms[low + int(at[j])]) for j in first], key=lambda x: -x[0])[: self.top]
            for i in range(len(sums)):
                for j in range(n):
                    if j != block + i:
                        yield self.lang, self.names[block + i], "pair", self.names[j], int(sums[i, j])
        for s, found in enumerate(best):
            for value, term in found:
                yield self.lang, self.names[s], "term", term.decode(), value


_RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_RESULT_DDL = "lang string, source string, part string, item string, value long"


def _diverge(top: int):
    def run(batches):
        held, key, rows = None, None, []

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)
            rows.clear()
            return out

        def close():
            for row in held.results() if held is not None and held.terms else ():
                rows.append(row)
                if len(rows) == 50_000:
                    yield full()

        for batch in batches:
            for part, lang, source, total, kinds, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang) != key:
                    yield from close()
                    held, key = _Language(lang, top), (part, lang)
                if term is None:
                    held.head(source, total, kinds)
                else:
                    held.leaf(term, sources, counts)
        yield from close()
        if rows:
            yield full()

    return lean(run)


def term_tries(docs: DataFrame, least: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Merged leaves: ``part_range, lang, term, docs, sources, counts`` of terms in at least ``least`` documents of a language, and each language's root (an empty term) with its documents by source."""
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    leaves = staged(d.mapInArrow(lean(_count), _LEAF_DDL), "tries")
    ranges = max(shuffle_partitions(spark), -(-leaves.count() // RANGE_ROWS))
    ordered = leaves.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    return staged(ordered.mapInArrow(lean(_merge(least)), _KEPT_DDL), "terms")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from each other one (part ``pair``), and the terms that it has more of than the language (part ``term``, the first ``top``).

    Terms are runs of ASCII letters, in lower case, and of characters above ASCII; a language keeps those in at least
    ``least`` of its documents.  A term's share in a group is ``1 + floor(10^9 (count + 2) / (N + 2 V))``; two shares are
    ``floor((p - q)^2 / (p + q))`` apart, and sources by the sum over all kept terms.

    Null text, language and source are empty ones, which are groups like any other.  Every row counts as a document,
    repeated ones too.  Ties go in the order of UTF-8.  A language without kept terms has pairs of value 0; one with a
    single source has none.  Other columns aren't read; an empty table gives no rows.
    """
    kept = term_tries(docs, least, lang_col, source_col, text_col)
    terms, roots = kept.filter("length(term) > 0"), kept.filter("length(term) = 0")
    groups = roots.select("lang", F.explode("sources").alias("source"))
    cells = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    sums = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = staged(groups.join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds")), "totals")
    # Each range gets the totals of its languages as rows before its leaves, so nothing is broadcast.
    heads = terms.select("part_range", "lang").distinct().join(totals, "lang").select("part_range", "lang", "source", "total", "kinds", *[F.lit(None).cast(t).alias(c) for c, t in (("term", "binary"), ("sources", "array<string>"), ("counts", "array<bigint>"))])
    own = terms.select("part_range", "lang", *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("total", "bigint"), ("kinds", "bigint"))], "term", "sources", "counts")
    mixed = heads.unionByName(own).repartition(shuffle_partitions(docs.sparkSession), "part_range").sortWithinPartitions("part_range", "lang", F.col("term").asc_nulls_first(), "source")
    found = staged(mixed.mapInArrow(_diverge(top), _RESULT_DDL), "divergence")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = totals.filter("kinds = 0")
    alike = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = pairs.unionByName(alike).withColumn("rank", F.row_number().over(w))
    # Each task keeps the first ones of each source before they are dealt out.
    return ranked.unionByName(found.filter("part = 'term'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All pairs of sources and the first ten terms of each source; nulls are empty strings; an empty table gives no rows."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM x),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
