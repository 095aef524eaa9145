"""Repeated passages: remove every byte that a long string covers which also starts earlier in the corpus.

The suffix order is built where strings can repeat, and it decides what is removed.  Each window of ``length`` bytes has
an anchor, the least hash of its byte k-grams (leftmost of equals); equal windows have equal anchors at equal offsets.
Windows that follow each other and share an anchor position make a segment (24 bytes of hashes and places, whatever its
length).  Hashes only say where to look:

* Inside each batch, equal segments are put together before anything is shuffled, after a comparison of all their bytes:
  a passage in a third of all rows reaches the shuffle once for each batch.
* An anchor that is left with one segment (nearly all of them) can't repeat and costs no more than its row.
* The bytes of all other segments are fetched, dealt out by anchor, and put into suffix order by two-stage sorting.  Runs
  of neighbours with a common prefix of ``length`` bytes are the equal windows; all but the earliest of each are covered.
* A hot anchor (the border of a passage that very many texts share, with other words beside it in each) is known from a
  sample of texts beforehand, and its windows are dealt out by a hash of all their bytes instead, so no task collects it.
  Which anchors are taken apart changes the work and not the result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, ids_repeat, lean, shuffle_partitions, staged, table, text_slices, unique_documents

KGRAM = 20
SLICE = 1 << 20  # bytes hashed at a time
BATCH = 24 << 20  # bytes of text whose segments are collapsed together
GROUP = 512 << 10  # bytes of segments in one suffix array, where anchors allow it
BLOCK = 2048  # rows of an anchor from which the copies of a segment are sorted in blocks, each with the first one
HOT, RATE = 4096, 256  # different segments of a hot anchor; one text in so many tells
HOT_KEYS = 1 << 22  # most anchors that are sent to all executors (32 MB)

_MULT = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte; powers of an odd base and of its inverse, modulo 2^64."""
    rng = np.random.default_rng(77)
    values = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    n = SLICE * 2 + 1024
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(_MULT)
    x ^= x >> np.uint64(29)
    return x


def segments(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, k: int = KGRAM):
    """Segments of the texts ``buf[begins[i]:ends[i]]`` that lie one after the other in ``buf``.

    Returns arrays: anchor hash, hash of the segment's bytes, text, first window (in buf), windows.
    """
    w = length - k + 1
    values, up, down = _tables()
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * up[:n], out=total[1:])
    m = n - k + 1
    h = _mix((total[k:] - total[:m]) * down[:m])
    # The least of w values that follow each other: doubling, then two overlapping halves.
    low, span = h, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    # Windows of each text.
    has = ends - begins >= length
    text = np.flatnonzero(has)
    counts = (ends - begins - length + 1)[has]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    at = np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(begins[has] - starts, counts)
    value = low[at]
    # A segment ends where the least value changes or its leftmost place drops out of the window.
    first = np.ones(len(at), bool)
    first[1:] = (value[1:] != value[:-1]) | (h[at[:-1]] == value[:-1])
    first[starts] = True
    lo = np.flatnonzero(first)
    number = np.diff(np.append(lo, len(at)))
    begin = at[lo]
    own = (total[begin + number + length - 1] - total[begin]) * down[begin] + number.astype(np.uint64)
    return value[lo], _mix(own), text[np.searchsorted(starts, lo, side="right") - 1], begin, number


_SEG = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("marks", pa.binary())])
_SEG_DDL = "key long, seg long, doc_id long, place long, marks binary"
# place: first window * 2^12 + windows (at most length - k + 1 < 2^12)
_SHIFT = 12


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, as one number."""
    return np.ndarray(max(0, len(buf) - 7), "<u8", buf, strides=(1,))


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` and from ``b`` on are the same, for so many bytes (eight at least)."""
    same = np.ones(len(a), bool)
    for o in range(0, int(sizes.max(initial=0)), 8):
        live = np.flatnonzero(same & (sizes > o))
        at = np.minimum(o, sizes[live] - 8)
        same[live] = raw[a[live] + at] == raw[b[live] + at]
    return same


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch put together; ``lo`` is in order."""
    if not len(lo):
        return lo, hi
    far = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > far[:-1]])
    at = np.flatnonzero(new)
    return lo[at], far[np.append(at[1:] - 1, len(lo) - 1)]


def _batch_segments(ids: np.ndarray, texts: list[bytes], length: int):
    order = np.argsort(ids, kind="stable")
    """Segments of a batch in the order (id, place): anchor hash, hash of the bytes, row, first window, windows."""
    parts = []
    todo: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        nonlocal todo, held
        if todo:
            sizes = np.array([len(t) for _, _, t in todo])
            ends = np.cumsum(sizes)
            key, seg, text, begin, number = segments(np.frombuffer(b"".join(t for _, _, t in todo), np.uint8), ends - sizes, ends, length)
            which, shift = np.array([i for i, _, _ in todo]), np.array([o for _, o, _ in todo])
            parts.append((key, seg, which[text], begin - (ends - sizes)[text] + shift[text], number))
        todo, held = [], 0

    for i in order:
        t = texts[i]
        if len(t) < length:
            continue
        # A very long text goes in pieces that overlap by a window less one byte: each window lies in just one.
        for o in range(0, len(t) - length + 1, SLICE):
            piece = t[o : o + SLICE + length - 1]
            if held + len(piece) > SLICE:
                flush()
            todo.append((i, o, piece))
            held += len(piece)
    flush()
    if not parts:
        return None
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _apart(found: list[np.ndarray], hot: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """Segments of hot anchors as single windows, whose keys are hashes of all their bytes."""
    key, seg, row, begin, number = found
    at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    is_hot = hot[at] == key if len(hot) else np.zeros(len(key), bool)
    if not is_hot.any():
        return found
    n = number[is_hot]
    rows, starts = np.repeat(row[is_hot], n), np.repeat(begin[is_hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
    new = np.zeros(len(rows), np.uint64)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])), len(rows))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        raw = _words_at(np.frombuffer(texts[rows[a]], np.uint8))
        for o in [*range(0, length - 8, 8), length - 8]:
            new[a:b] = _mix((new[a:b] ^ raw[starts[a:b] + o]) * np.uint64(_MULT))
    out = [np.concatenate([x[~is_hot], y]) for x, y in zip(found, (new, _mix(new ^ np.uint64(_MULT)), rows, starts, np.ones(len(rows), np.int64)), strict=True)]
    texts_in_order = np.argsort(np.unique(row, return_index=True)[1], kind="stable")
    rank = np.zeros(int(row.max()) + 1, np.int64)
    rank[np.unique(row)[texts_in_order]] = np.arange(len(texts_in_order))
    by = np.lexsort((out[3], rank[out[2]]))
    return [x[by] for x in out]


def _map_segments(length: int, hot):
    """Segments by anchor; equal ones of a batch are put together, and all but the earliest become marks."""

    def run(batches):
        anchors = hot.value
        for whole in batches:
            for batch in text_slices(whole, 1, BATCH):
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), byte_texts(batch, 1)
                found = _batch_segments(ids, texts, length)
                if found is None:
                    continue
                key, seg, row, begin, number = _apart(found, anchors, texts, length)
                # Rows come in the order (id, place): of equal segments the first is the earliest.
                both = key ^ (seg << np.uint64(1)) ^ (seg >> np.uint64(63))
                order = np.argsort(both, kind="stable")
                same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (seg[order][1:] == seg[order][:-1]) & (number[order][1:] == number[order][:-1])])
                first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                gone, of = order[same], first[same]
                starts = np.cumsum([0, *map(len, texts[:-1])])
                raw = _words_at(np.frombuffer(b"".join(texts) + bytes(8), np.uint8))
                true = _same_bytes(raw, starts[row[gone]] + begin[gone], starts[row[of]] + begin[of], number[gone] + length - 1)
                seg[gone[~true]] ^= _mix(gone[~true].astype(np.uint64) + np.uint64(_MULT))  # equal hashes of different bytes: the suffix order tells
                gone = np.sort(gone[true])
                kept = np.ones(len(key), bool)
                kept[gone] = False
                keep = np.flatnonzero(kept)
                n = len(keep)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(seg[keep].view(np.int64)), pa.array(ids[row[keep]]), pa.array(begin[keep] << _SHIFT | number[keep]), pa.nulls(n, pa.binary())], schema=_SEG)
                if len(gone):
                    cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(row[gone]) != 0])), len(gone))
                    docs, blobs = [], []
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        g = gone[a:b]
                        lo, hi = _merge(begin[g], begin[g] + number[g] + length - 1)
                        docs.append(ids[row[g[0]]])
                        blobs.append(np.stack([lo, hi], 1).astype("<i8").tobytes())
                    docs = np.array(docs)
                    # Marks only pass through the shuffle; their keys spread them.
                    yield pa.RecordBatch.from_arrays([pa.array(_mix(docs.astype(np.uint64) * np.uint64(_MULT)).view(np.int64)), pa.array(np.zeros(len(docs), np.int64)), pa.array(docs), pa.array(np.full(len(docs), -1)), pa.array(blobs, pa.binary())], schema=_SEG)

    return lean(run)


def _sampled_segments(length: int):
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 1, BATCH):
                found = _batch_segments(np.arange(batch.num_rows), byte_texts(batch, 1), length)
                if found is not None:
                    pairs = np.unique(np.stack(found[:2], 1), axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=schema)

    return lean(run)


def hot_anchors(d: DataFrame, length: int, hot: int, rate: int) -> np.ndarray:
    """Anchors with about ``hot`` different segments or more, in order, as one text in ``rate`` tells; at most HOT_KEYS."""
    some = d.filter((F.octet_length("text") >= length) & (F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0))
    pairs = staged(some.mapInArrow(_sampled_segments(length), "key long, seg long").distinct(), "sampled")
    least = max(2, hot // rate, -(-pairs.count() // HOT_KEYS))
    keys = pairs.groupBy("key").count().filter(F.col("count") >= least).select("key").toPandas()["key"].to_numpy(np.int64)
    return np.sort(keys.view(np.uint64))


_OUT = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())])
_OUT_DDL = "doc_id long, lo long, hi long, key long, marks binary"


def _blocks_of(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and blocks of an anchor with very many rows; ``first`` marks the first row of each segment.

    Different segments meet in block zero; the copies of each go in further blocks, each with the first one.
    """
    heads = np.flatnonzero(first)
    rows, blocks, block = [heads], [np.zeros(len(heads), np.int64)], 0
    for a, b in zip(heads, np.append(heads[1:], len(first)), strict=True):
        for at in range(a + 1, b, most - 1):
            block += 1
            own = np.concatenate([[a], np.arange(at, min(at + most - 1, b))])
            rows.append(own)
            blocks.append(np.full(len(own), block))
    return np.concatenate(rows), np.concatenate(blocks)


def _asks(length: int, most: int):
    """Over rows sorted by (key, seg, doc_id, place): the segments to be put in suffix order, those of an anchor with several rows."""

    def settle(key, seg, doc, place):
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new_key)
        sizes = np.diff(np.append(heads, len(key)))
        first = new_key.copy()
        first[1:] |= seg[1:] != seg[:-1]
        few = np.repeat((sizes > 1) & (sizes <= most), sizes)
        rows, blocks = [np.flatnonzero(few)], [np.zeros(int(few.sum()), np.int64)]
        for a, n in zip(heads[sizes > most], sizes[sizes > most], strict=True):
            r, b = _blocks_of(first[a : a + n], most)
            rows.append(r + a)
            blocks.append(b)
        take, block = np.concatenate(rows), np.concatenate(blocks)
        lo = place[take] >> _SHIFT
        hi = lo + (place[take] & ((1 << _SHIFT) - 1)) + length - 1
        dealt = np.where(block > 0, key[take] ^ _mix(block.astype(np.uint64) * np.uint64(_MULT)).view(np.int64), key[take])
        return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(lo), pa.array(hi), pa.array(dealt), pa.nulls(len(take), pa.binary())], schema=_OUT)

    def run(batches):
        held: list = []
        for batch in batches:
            place = batch.column(3).to_numpy()
            marks = place < 0
            if marks.any():
                b = batch.filter(pa.array(marks))
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(2), none, none, none, b.column(4)], schema=_OUT)
            now = [batch.column(i).to_numpy()[~marks] for i in range(4)]
            key = now[0]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if held and (cut or held[-1][0][-1] != key[0]):
                yield settle(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)))
                held = []
            elif cut:
                yield settle(*[x[:cut] for x in now])
            held.append([x[cut:] for x in now])
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lean(run)


_PART = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
_PART_DDL = "key long, doc_id long, lo long, bytes binary"


def _zipped(batches):
    """Texts as they go through shuffles: compressed, each by itself."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("zipped", pa.binary())])
    pack = zstandard.ZstdCompressor(level=1).compress
    for whole in batches:
        for batch in text_slices(whole, 2, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(pack, byte_texts(batch, 2)), pa.binary())], schema=schema)


def _fetch(batches):
    """The bytes of the segments asked for, from their whole texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        asked = batch.column(2)
        cuts = np.asarray(asked.offsets)
        key, lo, hi = (asked.flatten().field(i).to_numpy() for i in range(3))
        docs = np.repeat(batch.column(0).to_numpy(), np.diff(cuts))
        cuts, parts, at = cuts - cuts[0], [], 0

        def rows(at, parts, key=key, docs=docs, lo=lo):
            now = slice(at, at + len(parts))
            return pa.RecordBatch.from_arrays([pa.array(key[now]), pa.array(docs[now]), pa.array(lo[now]), pa.array(parts, pa.binary())], schema=_PART)

        for i, zipped in enumerate(batch.column(1)):
            text = unpack(zipped.as_py())
            for c in range(cuts[i], cuts[i + 1], 1 << 14):
                now = slice(c, min(c + (1 << 14), cuts[i + 1]))
                parts += [text[x:y] for x, y in zip(lo[now].tolist(), hi[now].tolist(), strict=True)]
                if len(parts) >= 1 << 14:
                    yield rows(at, parts)
                    at, parts = at + len(parts), []
        if parts:
            yield rows(at, parts)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the end of the text is smaller than all symbols."""
    n = len(text)
    small = np.zeros(n, bool)
    differ = np.flatnonzero(text[1:] != text[:-1])
    if len(differ):
        runs = np.diff(np.concatenate([[0], differ + 1]))
        small[: differ[-1] + 1] = np.repeat(text[differ] < text[differ + 1], runs)
    return small


def two_stage_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of ``text`` (uint8 symbols), right in the first ``depth`` symbols at least.

    Stage one sorts the suffixes that are smaller than their successors by their symbols.  Stage two goes through the
    buckets (first symbols) upwards: once a bucket is whole, the suffixes one place before its own that are larger
    than their successors follow in that order in the buckets of their own first symbols.

    With ``wanted`` (a mask), only these suffixes and those that they are induced from are put in order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    if wanted is None:
        needed = np.ones(n, bool)
    else:
        # A wanted suffix larger than its successor is induced from there, and so on up to one that is smaller.
        number = np.concatenate([[0], np.cumsum(small)[:-1]])  # smaller ones before each place
        up_to = np.append(np.flatnonzero(small), n - 1)[number[wanted]]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.flatnonzero(wanted), 1)
        np.subtract.at(step, up_to + 1, 1)
        needed = np.cumsum(step)[:n] > 0
        needed[n - 1] = True
    chosen = np.flatnonzero(small & needed)
    # Stage one, eight symbols at a time, and only where the order isn't settled yet.
    words = np.zeros(n + depth + 16, np.uint8)
    words[:n] = text
    raw = np.ndarray(n + depth + 8, ">u8", words, strides=(1,))

    def word(p: np.ndarray) -> np.ndarray:
        return raw[p].astype(np.uint64)

    value = word(chosen)
    by = np.argsort(value, kind="stable")
    order, value = chosen[by], value[by]
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    for o in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        group, value = np.cumsum(new[tied]), word(np.minimum(order[tied] + o, n + depth))
        # Most ties stay ties: only groups with different values are put in order again.
        heads = new[tied]
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][~heads[1:] & (value[1:] != value[:-1])]] = True
        again = np.flatnonzero(mixed[group])
        if not len(again):
            continue
        by = again[np.lexsort((value[again], group[again]))]
        at = tied[again]
        order[at], v = order[tied[by]], value[by]
        split = np.zeros(len(again), bool)
        split[1:] = v[1:] != v[:-1]
        new[at] |= split
    # Stage two.
    small_of = np.split(order, np.searchsorted(text[order], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    done = []
    larger_needed = needed & ~small

    def give(p: np.ndarray, bucket: int) -> np.ndarray:
        """Hands on the larger suffixes before ``p``; returns those of the same bucket."""
        q = p[p > 0] - 1
        q = q[larger_needed[q]]
        s = text[q]
        same = q[s == bucket]
        q, s = q[s > bucket], s[s > bucket]
        if len(q):
            by = np.argsort(s, kind="stable")
            q, s = q[by], s[by]
            cuts = np.flatnonzero(np.diff(s)) + 1
            for part in np.split(q, cuts):
                waiting[text[part[0]]].append(part)
        return same

    for bucket in range(256):
        larger = np.concatenate(waiting[bucket]) if waiting[bucket] else np.zeros(0, np.int64)
        waiting[bucket] = []
        while len(larger):  # first those with smaller next symbols, then runs of one symbol, the shortest first
            done.append(larger)
            larger = give(larger, bucket)
        own = small_of[bucket]
        if len(own):
            done.append(own)
            give(own, bucket)  # those of the same bucket before a smaller suffix are smaller ones themselves
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` and the one before it, counted up to ``depth``."""
    n = len(text)
    words = np.zeros(n + depth + 16, np.uint8)
    words[:n] = text
    raw = np.ndarray(n + depth + 8, "<u8", words, strides=(1,))
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for o in range(0, depth, 8):
        if not len(live):
            break
        differ = raw[order[live] + o] ^ raw[order[live - 1] + o]
        # The lowest byte in which they differ.
        low = differ & (~differ + np.uint64(1))
        lcp[live] = o + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> np.uint64(3)).astype(np.int64)
        live = live[differ == 0]
    return np.minimum(lcp, depth)


def repeats(blobs: list[bytes], docs: np.ndarray, los: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the segments ``blobs`` that start earlier in another place: (doc_id, start)."""
    sizes = np.array([len(b) for b in blobs])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    counts = sizes - length + 1
    which = np.repeat(np.arange(len(blobs)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.full(len(text), -1)
    window[begins[which] + offset] = np.arange(len(which))
    order = two_stage_order(text, length, window >= 0)
    order = order[window[order] >= 0]
    group = np.cumsum(common_prefixes(text, order, length) < length)
    w = window[order]
    size = np.bincount(group)
    shared = size[group] > 1
    w, group = w[shared], group[shared]
    doc, start = docs[which[w]], los[which[w]] + offset[w]
    by = np.lexsort((start, doc, group))
    doc, start, group = doc[by], start[by], group[by]
    # A window lies in one segment of its text only, as each has one anchor; a segment asked for in several blocks is the same place.
    later = np.zeros(len(group), bool)
    later[1:] = (group[1:] == group[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    return doc[later], start[later]


_RUNS = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("marks", pa.binary())])
_RUNS_DDL = "doc_id long, lo long, hi long, marks binary"


def _suffix_groups(length: int):
    """Over segments sorted by key: the runs of windows that start earlier elsewhere."""

    def emit(parts):
        columns = [np.concatenate([p[i] for p in parts]) for i in (1, 2)]
        doc, start = repeats([b for p in parts for b in p[3]], *columns, length)
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:] - 1, len(doc) - 1)[: len(first)]
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last] + length), pa.nulls(len(first), pa.binary())], schema=_RUNS)

    def run(batches):
        held: list = []
        size = 0
        for whole in batches:
            for batch in text_slices(whole, 3, GROUP // 4):
                now = [*(batch.column(i).to_numpy() for i in range(3)), batch.column(3).to_pylist()]
                key = now[0]
                cut = int(np.searchsorted(key, key[-1], side="left"))
                if size + batch.column(3).nbytes >= GROUP and (cut or held and held[-1][0][-1] != key[0]):
                    held.append([x[:cut] for x in now])
                    yield emit(held)
                    held, size, now = [], 0, [x[cut:] for x in now]
                held.append(now)
                size += sum(map(len, now[3]))
        if held:
            yield emit(held)

    return lean(run)


def _cut():
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for doc, zipped, spans, marks in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, pairs = unpack(zipped.as_py()), [np.frombuffer(m, "<i8").reshape(-1, 2) for m in marks.as_py() or []]
                if spans.values is not None and len(spans.values):
                    pairs.append(np.stack([spans.values.field(i).to_numpy() for i in range(2)], 1))
                if pairs:
                    pairs = np.concatenate(pairs)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    lo, hi = _merge(pairs[:, 0], pairs[:, 1])
                    kept = b"".join(text[a:b] for a, b in zip(np.concatenate([[0], hi]), np.concatenate([lo, [len(text)]]), strict=True))
                    rows.append((doc.as_py(), len(text), int((hi - lo).sum()), len(lo), kept, np.stack([lo, hi], 1).ravel().tolist()))
                else:
                    rows.append((doc.as_py(), len(text), 0, 0, text, []))
                size += len(rows[-1][4])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def repeated_spans(d: DataFrame, zipped: DataFrame, length: int, hot: int = HOT, rate: int = RATE, block: int = BLOCK) -> DataFrame:
    """Marks ``(doc_id, lo, hi, marks)`` in bytes for ``(doc_id, text)`` with unique ids, which ``zipped`` has too; marks may overlap."""
    if length - KGRAM + 1 >= 1 << _SHIFT or length < 2 * KGRAM:
        raise ValueError(f"length: {length}")
    anchors = d.sparkSession.sparkContext.broadcast(hot_anchors(d, length, hot, rate))
    seg = d.filter(F.octet_length("text") >= length).mapInArrow(_map_segments(length, anchors), _SEG_DDL)
    dealt = seg.repartition("key").sortWithinPartitions("key", "seg", "doc_id", "place")
    found = staged(dealt.mapInArrow(_asks(length, block), _OUT_DDL), "segments")
    asked = found.filter("key is not null").groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("asked"))
    fetched = zipped.select(F.col("place").alias("doc_id"), "zipped").join(asked, "doc_id").select("doc_id", "zipped", "asked").mapInArrow(lean(_fetch), _PART_DDL)
    runs = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_suffix_groups(length), _RUNS_DDL)
    return found.filter("key is null").select("doc_id", "lo", "hi", "marks").unionByName(runs)


def _with_places(d: DataFrame) -> DataFrame:
    """Adds ``place``, a number for each text that keeps the order: the id itself, unless ids repeat."""
    if not ids_repeat(d):
        return d.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    filled = d.filter("text <> ''").select("doc_id").distinct()
    empty = d.filter("text = ''")
    d = d.filter("text <> ''").unionByName(empty.join(filled.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti"))
    sha = F.sha2("text", 256)
    ranged = d.withColumn("sha", sha).repartitionByRange(shuffle_partitions(d.sparkSession), "doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    return staged(ranged.withColumn("place", F.monotonically_increasing_id()).drop("sha"), "places")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT, rate: int = RATE, block: int = BLOCK) -> DataFrame:
    """One row for each id: ``doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (flat list of byte starts and ends)``.

    A byte goes if it is covered by ``length`` bytes that also start earlier: in a text with a smaller id, or earlier
    in the same text; overlapping occurrences count.  Strings are judged on the input and never cross texts.

    An anchor with about ``hot`` different segments, as one text in ``rate`` tells, is taken apart into windows; one with
    more than ``block`` rows has the copies of each segment sorted in blocks.  The result is the same with any of these,
    but for one thing: in blocks, copies are compared with the first of equal 64-bit hashes and not with each other.

    Null texts are empty; texts shorter than ``length`` lose nothing.  Every different text under an id has its row;
    repeated rows are one text, and an empty text beside others under its id has no row.  Texts of one id go in the
    order of their SHA-256; a null id is an id too, the smallest.  Other columns aren't read.
    """
    d = _with_places(unique_documents(docs, id_col, text_col))
    zipped = d.select("doc_id", "place", "text").mapInArrow(lean(_zipped), "doc_id long, place long, zipped binary")
    marks = repeated_spans(d.select(F.col("place").alias("doc_id"), "text"), zipped, length, hot, rate, block).groupBy("doc_id").agg(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))).alias("spans"), F.collect_list("marks").alias("marks"))
    cut = zipped.join(marks.withColumnRenamed("doc_id", "place"), "place", "left").select("doc_id", "zipped", "spans", "marks")
    return cut.mapInArrow(lean(_cut()), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each different text under an id; null and empty texts have no bytes; see ``remove_repeats`` for repeated and null ids; an empty table gives no rows."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
