import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm import config_lp, lp_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(items, size):
    rooms, n = [], 0
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            n += 1
            rooms.append(size - x)
    return n


@pytest.mark.parametrize("items", [[3, 3, 4], [10] * 7, [6, 4] * 20, [1] * 100, [7, 6, 5, 5, 4, 3, 2, 1, 9], []])
def test_plan_holds_every_item(items):
    packed = config_lp.plan(dict(Counter(items)), 10)
    assert Counter(x for bins, n in packed.bins for _ in range(n) for x in bins) == Counter(items)
    assert all(sum(b) <= 10 for b, _ in packed.bins)
    assert packed.bound - 1e-6 <= packed.total <= max(best_fit_decreasing(items, 10), packed.bound)


def test_plan_is_near_the_bound_at_any_count():
    rng = np.random.default_rng(3)
    items = rng.integers(20, 180, 3000)
    for times in (1, 10**7):
        packed = config_lp.plan({int(k): int(n) * times for k, n in Counter(items.tolist()).items()}, 256)
        assert packed.total <= 1.01 * packed.bound + 3 and len(packed.bins) < 3000
    assert config_lp.plan(dict(Counter(items.tolist())), 256).total <= best_fit_decreasing(items.tolist(), 256)


def test_the_bound_is_one():
    # Three halves-and-a-bit need a bin each, whatever their sum is.
    assert config_lp.plan({6: 9}, 10).bound == pytest.approx(9) and config_lp.plan({6: 9}, 10).total == 9


def test_ids_are_the_tokenizers():
    rng, encoder, plain = random.Random(5), lp_packing.ByteEncoder(PATH), Tokenizer.from_file(PATH)
    some = [*"ab'sdtlrvem  \n\t\xa0\x85\x1c\x00\x0b1½²é_.,-!?ʰɏ", "'ll", "  ", "\n\n"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["<|endoftext|> a", "x <|endoftext|>y", "日本 語 x", "", None, " ", "a"]
    flat, sizes = encoder.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert flat[at : at + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
        at += n


def check(df, docs, size, end_id):
    """Every id of every document in exactly one piece; sequences gapless and not overfull."""
    plain = Tokenizer.from_file(PATH)
    rows = df.collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(np.array([*plain.encode(text or "", add_special_tokens=False).ids, end_id], "<u4"))
    assert set(by_doc) == set(want)
    for doc, found in by_doc.items():
        expected = Counter()
        for ids in want[doc]:
            first = len(ids) % size or size
            cuts = [0, *range(first, len(ids) + 1, size)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                expected[(piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected, doc
        assert all(r.ids is None or zlib.crc32(r.ids) == r.ids_crc32 for r in found)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(r.length for r in rows)


def test_documents(spark, documents):
    from siltstone.llm.registry import QUERIES

    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    n, total = check(lp_packing.pack_best_fit(documents, PATH), rows, 2048, 0)
    assert n <= -(-total // 2048) + 3
    thin = QUERIES["op11_best_fit_packing"](spark, "/root/testdata/sf0.001")
    assert thin.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert thin.select("sequence_id").distinct().count() == n


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_odd_rows(spark, odd, empty, size):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(lp_packing.pack_best_fit(odd, PATH, size=size, end_id=5), rows, size, 5)
    assert lp_packing.pack_best_fit(empty, PATH).count() == 0


def test_one_length_holds_most_rows(spark):
    rows = [(i, "a b c" if i % 3 else "x " * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    n, total = check(lp_packing.pack_best_fit(docs, PATH, size=64), rows, 64, 0)
    assert n <= -(-total // 64) + 2
