"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector, projected to three coordinates (both in one table lookup: a fixed
random row for each id, averaged over the document), and placed on a Hilbert curve.  Documents are range-sorted by
their place on the curve and cut into full sequences one after the other, so neighbours on the curve share sequences.
Only the rest of each range (less than one sequence) is left over; the rests of many ranges are packed together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lean, shuffle_partitions, staged, table, text_slices, unique_documents

DIMS, ORDER = 3, 16  # coordinates, and bits of each
CACHE = 400_000  # parts of words whose ids a worker keeps (some 80 MB)
SLICE = 8 << 20  # bytes of text tokenized together
RANGE = 64 << 20  # bytes of ids in one range
RESTS = 256  # ranges whose rests are packed together


def hilbert(coords: np.ndarray, order: int) -> np.ndarray:
    """Place of each row of ``coords`` (n x dims, integers below 2^order) on the Hilbert curve (Skilling's transform)."""
    x = [coords[:, i].astype(np.int64) for i in range(coords.shape[1])]
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    place = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            place = place << 1 | ((x[i] ^ t) >> bit & 1)
    return place


LATIN = 0x250  # characters below it are their own normal form


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _of_category(first: str) -> str:
    """A regex class of the lower-case forms of the characters below LATIN in a general category."""
    found = {low for c in map(chr, range(LATIN)) for low in c.lower() if unicodedata.category(low)[0] == first}
    return "".join(map(re.escape, sorted(found)))


def _gather(held: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Runs of ``held`` (of these sizes, end to end), one for each code."""
    begins, ends = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(sizes[codes])])
    out = np.empty(ends[-1], held.dtype)
    for at in range(0, len(codes), 1 << 20):
        own = codes[at : at + (1 << 20)]
        lo, hi = ends[at], ends[at + len(own)]
        out[lo:hi] = held[np.arange(lo, hi) + np.repeat(begins[own] - ends[at : at + len(own)], sizes[own])]
    return out


class WordEncoder:
    """Ids of a lower-casing byte-pair tokenizer with word ends, with a cache of words' ids.

    Such a tokenizer joins nothing across white space, words and signs, so in a text of characters below LATIN (but
    for U+0130 and control characters, about which the tokenizer and Arrow or Python differ) that holds none of the
    tokenizer's special strings, each distinct string between white space is cut by itself and each distinct part goes to
    the merge model once, unless the cache holds it.  Any other text goes through the tokenizer whole.  Both give the
    tokenizer's own ids.
    """

    _held: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = {}, {}
        special = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[\\x00-\\x08\\x0e-\\x1f\\x7f\\x{{130}}\\x{{{LATIN:x}}}-\\x{{10ffff}}]", *special])
        letters, numbers = _of_category("L"), _of_category("N")
        self.cut = re.compile(f"\\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self.symbols = _byte_symbols()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _parts(self, parts: np.ndarray) -> list[bytes]:
        """Ids of each part.  The cache has two generations: what was asked for since the last turn stays through the next one."""
        tokenize, young, old, out = self.tokenizer.model.tokenize, self.young, self.old, []
        for part in parts:
            ids = young.get(part)
            if ids is None:
                ids = old.get(part)
                if ids is None:
                    symbols = part if part.isascii() else part.encode().decode("latin-1").translate(self.symbols)
                    ids = array("H", [x.id for x in tokenize(symbols)]).tobytes() if part != "\n" else b""
                young[part] = ids
            out.append(ids)
        if len(young) > CACHE // 2:
            self.young, self.old = {}, young
        return out

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words put end to end, and how many each has."""
        parts = pa.array(self.cut("\n".join(words).lower()), pa.string()).dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False)
        blobs = self._parts(names)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        codes = np.asarray(parts.indices)
        word = np.cumsum(codes == np.flatnonzero(names == "\n")[0]) if len(words) > 1 else np.zeros(len(codes), np.int64)
        return _gather(np.frombuffer(b"".join(blobs), np.uint16), sizes, codes), np.bincount(word, sizes[codes], len(words)).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.utf8_split_whitespace(texts)
        heads = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        held, sizes = self._words(coded.dictionary.to_numpy(zero_copy_only=False))
        codes = np.asarray(coded.indices)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return _gather(held, sizes, codes), ends[heads[1:]] - ends[heads[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (16 bits) of all texts put end to end, and how many each has; null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        flat, few = self._plain(texts.filter(pa.array(~odd)))
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = few
        own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = [len(x) for x in own]
        out, is_odd = np.empty(int(sizes.sum()), np.uint16), np.repeat(odd, sizes)
        out[~is_odd] = flat
        out[is_odd] = np.concatenate(own)
        return out, sizes


def _projection(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(4242).standard_normal((vocabulary, DIMS)).astype(np.float32)


def curve_places(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hilbert places of documents whose ids (one at least) lie end to end."""
    heads = np.concatenate([[0], np.cumsum(sizes)])
    coords = np.zeros((len(sizes), DIMS))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(heads, heads[at] + (1 << 20), side="right")) - 1)
        coords[at:end] = np.add.reduceat(rows[flat[heads[at] : heads[end]]], heads[at:end] - heads[at], axis=0) / sizes[at:end, None]
        at = end
    # Means of many random rows lie near zero; tanh keeps the outer ones in the cube.
    cells = ((np.tanh(coords * 4) + 1) / 2 * ((1 << ORDER) - 1)).astype(np.int64)
    return hilbert(cells, ORDER)


_DOC = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.large_binary())])


def _tokenize(path: str, end_id: int):
    def run(batches):
        encoder = WordEncoder.of(path)
        rows = _projection(encoder.tokenizer.get_vocab_size())
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                flat, sizes = encoder.encode(batch.column(1))
                ends = np.cumsum(sizes + 1)
                ids, last = np.full(int(ends[-1]), end_id, np.uint16), np.zeros(int(ends[-1]), bool)
                last[ends - 1] = True
                ids[~last] = flat
                blobs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends * 2]).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(curve_places(ids, sizes + 1, rows)), batch.column(0), pa.array(sizes + 1), blobs], schema=_DOC)

    return lean(run)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("rest", pa.int32())])
_PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long, rest int"


class _Packer:
    """Cuts documents into sequences as they come; holds one open sequence."""

    def __init__(self, size: int, base: int, with_ids: bool):
        self.size, self.sequence, self.with_ids, self.fill, self.open, self.rows = size, base, with_ids, 0, [], []

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.fill, len(ids) - at)
            self.open.append((doc, start + at, take, total, self.sequence, self.fill, ids[at : at + take]))
            self.fill += take
            at += take
            if self.fill == self.size:
                self.close()

    def close(self) -> None:
        self.rows += [self.row(p, None) for p in self.open]
        self.open, self.fill, self.sequence = [], 0, self.sequence + 1

    def row(self, p, rest):
        *head, ids = p
        wide = ids.astype("<u4").tobytes()
        return (*head, wide if self.with_ids or rest is not None else None, None if rest is not None else zlib.crc32(wide), rest)

    def take(self, least: int = 0):
        if self.rows and len(self.rows) >= least:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)
            self.rows = []
            yield out


def _pack_ranges(size: int, with_ids: bool):
    def run(batches):
        part = TaskContext.get().partitionId()
        packer = _Packer(size, part << 36, with_ids)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(ids.as_buffer(), "<u2")
                packer.add(doc, 0, len(tokens), tokens)
                yield from packer.take(1024)
        packer.rows += [packer.row(p, part) for p in packer.open]
        yield from packer.take()

    return run


def _pack_rests(size: int, with_ids: bool):
    def run(batches):
        packer, group = None, None
        for batch in batches:
            for group_now, doc, start, total, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group_now != group:
                    if packer:
                        packer.close()
                        yield from packer.take()
                    group, packer = group_now, _Packer(size, (1 << 60) + (group_now << 36), with_ids)
                packer.add(doc, start, total, np.frombuffer(ids, "<u4"))
        if packer:
            packer.close()
            yield from packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` ids: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32``.

    ``ids`` (little-endian unsigned 32-bit) are null without ``with_ids``; ``sequence_id`` is unique, not dense.  All
    sequences are full but one for each 256 ranges.  ``end_id`` follows each document's ids.  ``tokenizer`` is the
    path of a tokenizer file whose vocabulary is below 65,536 and that never joins what white space separates; every
    executor has it.

    Null and empty texts have the end id alone.  Every different text under an id (null is one too) is packed, once;
    repeated rows are one document.  Other columns aren't read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = staged(unique_documents(docs, id_col, text_col).mapInArrow(_tokenize(tokenizer, end_id), "place long, doc_id long, n long, ids binary"), "tokens")
    ranges = max(shuffle_partitions(spark), -(-2 * (d.agg(F.sum("n")).first()[0] or 0) // RANGE))
    # Ties on the curve (copies) are dealt out by id, so no range grows with a group of copies.
    ranged = d.drop("n").repartitionByRange(ranges, "place", "doc_id").sortWithinPartitions("place", "doc_id").select("doc_id", "ids")
    pieces = staged(ranged.mapInArrow(lean(_pack_ranges(size, with_ids)), _PIECE_DDL), "pieces")
    rests = pieces.filter("rest is not null").select((F.col("rest") / RESTS).cast("long").alias("group"), "doc_id", "start", "doc_tokens", "ids", "rest", "offset")
    rests = rests.repartition("group").sortWithinPartitions("group", "rest", "offset").select("group", "doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack_rests(size, with_ids), _PIECE_DDL)
    return pieces.filter("rest is null").unionByName(rests).drop("rest")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every different text under an id; null and empty texts have the end id alone; an empty table gives no rows."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
