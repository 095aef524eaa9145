"""Best-fit packing: documents stay whole where they fit, and a linear program over the histogram of lengths says which lengths share a sequence.

Token ids never move: the task that tokenizes a document cuts it, digests its pieces and numbers pieces of one length
as they come.  Only the histogram, at most one number for each length, goes to the driver (``config_lp``).  Its answer
is a table of places, by length; a piece finds its own by the number it has among all pieces of its length.
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
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import lean, staged, table, text_slices
from siltstone.llm.config_lp import Plan, plan
from siltstone.llm.packing import CACHE, LATIN, SLICE, _byte_symbols, _gather

SPACE = "\t\n\x0b\x0c\r \x85\xa0"  # white space below LATIN
END = "\uffff"  # parts two strings; no text that holds it is cut here


def _of_category(first: str) -> str:
    """A regex class of the characters below LATIN in a general category."""
    return "".join(re.escape(c) for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == first)


class ByteEncoder:
    """Ids of a byte-level byte-pair tokenizer that splits as GPT-2's does, with a cache of parts' ids.

    Such a tokenizer joins nothing across a lone blank between two other characters, and gives the blank to what
    follows.  A text of characters below LATIN that holds none of the tokenizer's special strings is cut there, and each
    distinct part goes to the merge model once, unless the cache holds it.  Any other text goes through the tokenizer
    whole.  Both give the tokenizer's own ids.
    """

    _held: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = {}, {}
        special = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[\\x{{{LATIN:x}}}-\\x{{10ffff}}]", *special])
        letters, numbers, space = _of_category("L"), _of_category("N"), re.escape(SPACE)
        self.cut = re.compile(f"{END}|'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}{END}]+|[{space}]+(?![^{space}{END}])|[{space}]+").findall
        self.uneven = f"[ ][{SPACE}]|[{SPACE}][ ]|^ | $"  # a blank that isn't alone
        self.lone = re.compile(f"(?<=[^{space}]) (?=[^{space}])").split
        self.symbols = _byte_symbols()

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _parts(self, parts: np.ndarray) -> list[bytes]:
        """Ids of each part.  The cache has two generations: what was asked for since the last turn stays through the next one."""
        tokenize, young, old, symbols, out = self.tokenizer.model.tokenize, self.young, self.old, self.symbols, []
        for part in parts:
            ids = young.get(part)
            if ids is None:
                ids = old.get(part)
                if ids is None:
                    ids = array("H", [x.id for x in tokenize(part.encode().decode("latin-1").translate(symbols))]).tobytes() if part != END else b""
                young[part] = ids
            out.append(ids)
        if len(young) > CACHE // 2:
            self.young, self.old = {}, young
        return out

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings between lone blanks put end to end, and how many each has."""
        parts = pa.array(self.cut(END.join(units)), pa.string()).dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False)
        blobs = self._parts(names)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        codes = np.asarray(parts.indices)
        unit = np.cumsum(codes == np.flatnonzero(names == END)[0]) if len(units) > 1 else np.zeros(len(codes), np.int64)
        return _gather(np.frombuffer(b"".join(blobs), np.uint16), sizes, codes), np.bincount(unit, sizes[codes], len(units)).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts (none empty) without odd characters."""
        uneven = pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False)
        if uneven.any():
            even, own = pa.array(~uneven), [self.lone(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
            split = pa.chunked_array([pc.split_pattern(texts.filter(even), " ").cast(pa.list_(texts.type)), pa.array(own, pa.list_(texts.type))]).combine_chunks()
            order = np.argsort(np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)]))
            split = split.take(pa.array(order))
        else:
            split = pc.split_pattern(texts, " ")
        heads = np.asarray(split.offsets).astype(np.int64)
        heads = heads - heads[0]
        coded = split.flatten().dictionary_encode()
        codes, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        first, at = np.unique(codes[heads[:-1]], return_inverse=True)  # a text's first string has no blank before it
        codes[heads[:-1]] = len(names) + at
        held, sizes = self._units([" " + x for x in names] + [names[i] for i in first])
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return _gather(held, sizes, codes), ends[heads[1:]] - ends[heads[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (16 bits) of all texts put end to end, and how many each has; null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(texts).to_numpy() > 0)
        sizes = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, np.uint16)
        if plain.any():
            flat, sizes[plain] = self._plain(texts.filter(pa.array(plain)))
        if not odd.any():
            return flat, sizes
        own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = [len(x) for x in own]
        out, is_odd = np.empty(int(sizes.sum()), np.uint16), np.repeat(odd, sizes)
        out[~is_odd] = flat
        out[is_odd] = np.concatenate(own)
        return out, sizes


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: whole ones, and before them what is left over."""
    return ([n % size] if n % size else []) + [size] * (n // size)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part long, nth long"


def _cut(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), ByteEncoder.of(path)
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                flat, sizes = encoder.encode(batch.column(1))
                at, rows = 0, []
                for doc, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.uint16(end_id)).astype("<u4")
                    at, start = at + n, 0
                    for piece, length in enumerate(cut_lengths(n + 1, size)):
                        own = ids[start : start + length].tobytes()
                        rows.append((doc, piece, start, length, own if with_ids else None, zlib.crc32(own)))
                        start += length
                if not rows:
                    continue
                columns = list(zip(*rows, strict=True))
                lengths = np.array(columns[3], np.int64)
                order = np.argsort(lengths, kind="stable")
                heads = np.concatenate([[0], np.flatnonzero(np.diff(lengths[order])) + 1])
                runs = np.diff(np.append(heads, len(order)))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(heads, runs) + seen[lengths[order]]
                seen[lengths[order[heads]]] += runs
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _PIECE.types, strict=False)), pa.array(np.full(len(rows), part, np.int64)), pa.array(nth)], schema=_PIECE)

    return lean(run)


def places(packed: Plan) -> dict[int, np.ndarray]:
    """For each length the places of its pieces, in the order of their numbers: rows of (first number, first sequence, offset).

    A row stands for one position in all bins of one kind; its sequences follow one another.
    """
    rows: dict[int, list] = {}
    counted: dict[int, int] = {}
    first = 0
    for lengths, copies in packed.bins:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((counted.get(length, 0), first, offset))
            counted[length] = counted.get(length, 0) + copies
            offset += length
        first += copies
    return {k: np.array(v, np.int64) for k, v in rows.items()}


_PLACED = pa.schema([*list(_PIECE)[:6], ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"


def _place(held):
    def run(batches):
        by_length = held.value
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = by_length[int(length[own[0]])]
                at = np.searchsorted(rows[:, 0], number[own], side="right") - 1
                sequence[own], offset[own] = rows[at, 1] + number[own] - rows[at, 0], rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(_PLACED.types[i]) for i in range(6)), pa.array(sequence), pa.array(offset)], schema=_PLACED)

    return run


def pack_best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces in as few sequences of at most ``size`` ids as can be found: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    Each document's ids are followed by ``end_id``.  A document of at most ``size`` ids is one piece; a longer one is cut
    into pieces of ``size``, the first of which may be shorter.  ``ids`` (little-endian unsigned 32-bit) are null without
    ``with_ids``.  Sequences are numbered from 0.  ``tokenizer`` is the path of a byte-level tokenizer file whose
    vocabulary is below 65,536; every executor has it.  The table of places that is sent to executors has at most as
    many rows as there are lengths in the different kinds of bins (a few thousand kinds, by ``size``, at any number of
    documents).

    Every row is a document of its own, also where an id (null is one too) or a whole row repeats.  Null and empty texts
    have the end id alone.  Other columns aren't read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(d.mapInArrow(_cut(tokenizer, size, end_id, with_ids), _PIECE_DDL), "cut")
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    packed = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(lean(_place(spark.sparkContext.broadcast(places(packed)))), _PLACED_DDL)


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null and empty texts have the end id alone, repeated rows are packed each; an empty table gives no rows."""
    import public_tokenizers

    out = pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
