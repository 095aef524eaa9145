import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import periodic_runs
from siltstone.llm.registry import QUERIES


def brute_runs(w):
    """Every period is tried at every place, and smaller periods by comparing all words."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    kind = rng.randrange(5)
    n = rng.randrange(0, 90)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(4) for _ in range(n)]
    if kind == 2:  # powers of powers
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        inner = root * rng.randrange(1, 6) + [rng.randrange(3) for _ in range(rng.randrange(3))]
        return inner * rng.randrange(1, 6) + root[: rng.randrange(3)]
    if kind == 3:  # runs beside and over one another
        out = []
        for _ in range(rng.randrange(1, 6)):
            out += [rng.randrange(3) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 7)
        return out
    return list(range(rng.randrange(9))) + [7] * rng.randrange(20) + [rng.randrange(50) for _ in range(n)]


def test_against_every_period():
    rng = random.Random(11)
    some = 0
    for _ in range(4000):
        w = texts(rng)
        want = brute_runs(w)
        some += bool(want)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == want, w
    assert some > 1000


@pytest.mark.parametrize("w", [[0] * 200_000, [0, 1] * 100_000, ([0] * 999 + [1]) * 200, list(range(50_000)) * 4, ([0, 0, 1] * 300 + [2]) * 150, [int(x) for x in bin(3**90000)[2:]]])
def test_long_texts_take_little_time(w):
    began = time.perf_counter()
    found = periodic_runs.find_runs(np.array(w, np.int64))
    assert time.perf_counter() - began < 20 and found
    assert all(n >= max(6, 4 * q) for _, n, q in found)


def plain(doc, text):
    """A row of the query, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = quick_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


def quick_runs(w):
    """As ``brute_runs``, over arrays."""
    number = {}
    a = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    out = []
    for q in range(1, len(a) // 4 + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            m = j + q - i
            if m >= max(6, 4 * q) and not any((a[i : i + m - p] == a[i + p : i + m]).all() for p in range(1, q)):
                out.append((i, m, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, documents):
    got = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = [plain(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows(got) == sorted(want, key=str) and sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    want = [plain(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_periodic_runs"](spark, str(tmp_path))) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(empty).count() == 0
    by = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert by[3].runs[0].asDict() == {"start": 0, "length": 12000, "period": 4} and by[3].collapsed == "alpha beta gamma delta"
    assert by[1].collapsed == "" and by[1].runs == [] and by[7].collapsed == "ünï cödé 日本語 🎉 \x00\x1c x"
