"""Periodic runs of words: what a text repeats one after the other, four times or more.

A run with period q is at least 4 q words long, so for the largest power of two B up to q it holds two blocks that begin
at multiples of B, one after the other, and come again q words later.  For each scale B the aligned blocks go into an
automaton as sequences of word numbers, and the document is searched for them; where one comes again at a distance from
B up to 2 B, that distance is a candidate for a period, and the words around it are compared one by one, both ways, as
far as it holds.

Three things keep the work near n log n.  A block takes part only if each of its words comes again within 2 B words.  A
block deep inside a run of a smaller period can only start multiples of that period, as the run's root is primitive, so
it is left out.  And what one comparison has covered isn't compared again at the same distance.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, lean, table, text_slices

SHORTEST, TIMES = 6, 4  # words of a run at least, and periods


def _next_distance(words: np.ndarray) -> np.ndarray:
    """How many words later each word comes again (beyond the end: never)."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), 2 * len(words) + 2)
    again = words[order[1:]] == words[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _stretch(words: np.ndarray, begin: int, end: int, distance: int) -> tuple[int, int]:
    """The widest stretch around ``begin`` to ``end`` (known to hold) in which words ``distance`` apart are the same."""
    n, step = len(words) - distance, 32
    while end < n:
        to = min(n, end + step)
        differ = words[end:to] != words[end + distance : to + distance]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = to, 2 * step
    step = 32
    while begin > 0:
        to = max(0, begin - step)
        differ = (words[to:begin] != words[to + distance : begin + distance])[::-1]
        if differ.any():
            begin -= int(differ.argmax())
            break
        begin, step = to, 2 * step
    return begin, end + distance


class _Long:
    """The runs found so far that cover two blocks.  Two of them overlap by less than that, so both ends ascend."""

    def __init__(self, runs: list[tuple[int, int, int]], size: int):
        self.runs = sorted(r for r in runs if r[1] >= 2 * size)
        self.begins = [r[0] for r in self.runs]

    def covers(self, begin: int, end: int) -> int:
        """Period of the run that holds all of ``begin`` to ``end``, or 0."""
        at = bisect_right(self.begins, begin) - 1
        return self.runs[at][2] if at >= 0 and self.runs[at][0] + self.runs[at][1] >= end else 0


def _seeds(words: np.ndarray, starts: list[int], size: int):
    """(start of an aligned block, distance at which it comes again), distances from ``size`` up to twice that."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    named: dict[tuple, int] = {}
    at: dict[int, int] = {}
    for s in starts:
        key = tuple(words[s : s + size].tolist())
        at[s] = named.setdefault(key, len(named))
    for key, name in named.items():
        automaton.add_word(key, name)
    automaton.make_automaton()
    windows: list[list[int]] = []
    for s in starts:  # what is at most two blocks after one of them
        if windows and s + size <= windows[-1][1]:
            windows[-1][1] = s + 3 * size
        else:
            windows.append([s + size, s + 3 * size])
    for begin, end in windows:
        for last, name in automaton.iter(tuple(words[begin:end].tolist())):
            place = begin + last - size + 1
            s = (place - size) // size * size
            if at.get(s) == name:
                yield s, place - s


def find_runs(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All maximal stretches with smallest period q and at least ``max(shortest, times q)`` words, as (start, length, period).

    ``words`` are integers from 0, below 2^31; ``times`` is 4 at least.
    """
    n, runs, size = len(words), [], 1
    if n < shortest:
        return runs
    later = _next_distance(words)
    while times * size <= n:
        near = (later < 2 * size)[: n // size * size].reshape(-1, size).all(1)
        starts = np.flatnonzero(near[:-1] & near[1:]) * size
        if len(starts):
            held = _Long(runs, size)
            blocks = [s for s in starts.tolist() if not held.covers(s, s + 3 * size)]
            done: dict[int, tuple[int, int]] = {}
            for s, distance in _seeds(words, blocks, size) if blocks else ():
                begin, end = done.get(distance, (0, 0))
                if begin <= s and s + distance + size <= end:
                    continue
                period = held.covers(s, s + distance + size)
                if period and distance % period == 0:
                    continue
                begin, end = done[distance] = _stretch(words, s, s + size, distance)
                if end - begin >= max(shortest, times * distance):
                    period = held.covers(begin, end)
                    if not (period and distance % period == 0):
                        runs.append((begin, end - begin, distance))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)] if runs else words


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.large_string())])
_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _scan(rewrite: Callable | None):
    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 1, 8 << 20):
                ids, counts, found, kept = batch.column(0).to_pylist(), [], [], []
                for doc, text in zip(ids, byte_texts(batch, 1), strict=True):
                    words = text.split()  # bytes split at blanks and \t to \r alone
                    if rewrite is not None:
                        words = rewrite(doc, words)
                    number = dict(zip(words, range(len(words)), strict=True))
                    runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words))) if len(number) < len(words) else []
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(b" ".join(collapse(words, runs)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.large_binary()).cast(pa.large_string())], schema=_SCHEMA)

    return lean(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: every run of its words, and its text without what they repeat.

    Words are what blanks and the characters \\t to \\r separate.  ``runs`` are ordered by start and period;
    ``collapsed`` joins by one blank the words that no run holds after its first period.  ``rewrite(id, words)``, if
    given, changes a row's words before they are looked at.

    Null and empty texts have no words, no runs and an empty text.  Repeated rows each get theirs; other columns aren't
    read; an empty table gives no rows.  A text's time grows with its length times the logarithm of it.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan(rewrite), _DDL)


def planted_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: where the id's checksum ends in 0, what follows one place repeats with one period.  A null id changes nothing."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """One row for each document, repeated ones too; null and empty texts have no runs; an empty table gives no rows."""
    out = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_tail)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs go by start and period, so of equal ones the first stays.
    best = F.reduce("runs", none, lambda held, r: F.when(held.isNull() | (r["length"] * held["period"] > held["length"] * r["period"]), r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("b"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
