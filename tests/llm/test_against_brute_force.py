"""Contract queries on the smallest tables against plain programs."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


TRICKY = ["a@b.c.d_x@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.004", "é+1 (632) 555-4827 x", "4111 1111 1111 1111 and 4111-1111-1111-1112", "a@b a@@b.c x@y..z q@w.e.", "+1+1+12 345 678 901 234 567", "1" * 5000, "1 " * 3000, "a." * 4000 + "@b.c", "." * 10000, "日本 a@b.co 🎉 10.0.0.1", "0" * 30 + ".1.2.3", "+1 ((((((((((", None, ""]


@pytest.mark.parametrize("tricky", [False, True])
def test_op1_base_spans(spark, texts, tricky, tmp_path):
    if tricky:
        texts = dict(enumerate(TRICKY))
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op1_pii_weak"](spark, str(tmp_path) if tricky else SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone"))
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}


def test_op1_classifier_adds_spans_beside_base_ones(spark):
    from siltstone.llm.pii import find_personal_data

    rows = [(1, 'call (415) 555-2671, SSN 219-09-9999, Dr. Anna Smith, john (at) mail [dot] com; token = "abcdef0123456789"')]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got.base == [] and len(got.spans) >= 4


def test_op5_repeats(spark, documents, texts):
    from pyspark.sql import functions as F

    from siltstone.llm.suffix_dedup import remove_repeats

    made = {1: "ab" * 150, 2: "x" * 400, 3: None, 4: "ab" * 75 + "q" * 130, 5: "", 6: "q" * 130 + "zz" + "x" * 99, 7: "é" * 120, 8: "ab" * 150, 9: "q" * 300}
    for table in (texts, made):
        df = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(3)
        got = {r[0]: tuple(r)[1:] for r in remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
        seen = set()
        for i, t in sorted(table.items()):
            b = (t or "").encode()
            gone = np.zeros(len(b) + 2, bool)
            for p in range(len(b) - 99):
                w = b[p : p + 100]
                if w in seen:
                    gone[p + 1 : p + 101] = True
                seen.add(w)
            kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
            assert got[i] == (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())


def test_two_stage_order():
    from siltstone.llm.suffix_dedup import common_prefixes, two_stage_order

    rng = np.random.default_rng(5)
    for n, symbols in itertools.product((0, 1, 7, 300), (1, 2, 3, 256)):
        text = rng.integers(0, symbols, n).astype(np.uint8)
        b = text.tobytes()
        order = two_stage_order(text, n + 8)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = common_prefixes(text, order, n + 8)
        for k in range(1, n):
            x, y = b[order[k - 1] :], b[order[k] :]
            assert lcp[k] >= next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_op6_counts(spark, texts):
    import public_tokenizers

    from siltstone.llm.token_counts import SPACE, UNKNOWN, Unigram

    model = Unigram.of(public_tokenizers.path("piece_bpe_32k.model"))

    def best(word):
        b = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            k = len(word[e - 1].encode())
            b.append(max([(b[e - 1][0] + UNKNOWN * k, b[e - 1][1] - k)] + [(b[s][0] + model.scores[word[s:e]], b[s][1] - 1) for s in range(e) if word[s:e] in model.scores]))
        return -b[-1][1]

    for r in registry.QUERIES["op6_token_counts"](spark, SF).collect():
        words = texts[r.doc_id].split()
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(best(SPACE + w) for w in words))


def test_op7_packs_every_id_once(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in registry.QUERIES["op7_packing"](spark, SF).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for runs, size in [*((v, len(ids[k])) for k, v in pieces.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, length in sorted(runs):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at <= 4096
    assert sum(sum(n for _, n in v) < 4096 for v in sequences.values()) <= 1


def test_op7_encoder_and_curve():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from siltstone.llm.packing import WordEncoder, hilbert

    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["it's the DON'T we'LL 12²3 ½ a_b", "ΑΣ Σ σς", "İstanbul Ǆ ǅ Ⱥ", "é  x\x85y\x1cz a\xa0b", "<|endoftext|> hi", "日本語", "", " ", "x'S 'd ''s ª º µ", *map(chr, range(0x250)), *(f"a{chr(i)}b" for i in range(0x250))]
    odd += ["a <|startoftext|>b<|endoftext|><|endoftext", "\n a\n\nb ", None, "x" * 3000]
    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from the cache
        flat, sizes = e.encode(pa.array(odd, pa.string()))
        for text, got in zip(odd, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == fresh.encode(text or "", add_special_tokens=False).ids
    assert [x.tolist() for x in e.encode(pa.array([None, ""], pa.string()))] == [[], [0, 0]]
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    place = hilbert(grid, 3)
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_op8_base_places(spark, texts):
    from siltstone.llm.licenses import BASE_PHRASES

    for r in registry.QUERIES["op8_license_templates"](spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        found = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


WHOLE = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND ACME LTD DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL ACME LTD BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def test_op8_whole_texts(spark):
    """Whole licence texts with other names in them match; one mandatory word less and they don't."""
    from siltstone.llm.licenses import license_scan

    rows = [(k, w) for k, w in enumerate(x for label in sorted(WHOLE) for x in ("Copyright (c) 2020 Acme " + WHOLE[label] + " End.", WHOLE[label].replace("this permission notice", "permission notice")))]
    got = {r.doc_id: {m for m, a, b in zip(r.matches, r.match_starts, r.match_ends, strict=True) if b - a > 80} for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: {"isc"}, 1: set(), 2: {"mit-text"}, 3: set()}


def test_op8_automata():
    from siltstone.llm.licenses import Automaton

    a = Automaton("licensed under [[the {{which:1-2}} clause]] license [[version {{v:1-1}}]] end")
    yes = ["licensed under license end", "licensed under the big clause license end", "licensed under the very big clause license version 2 end"]
    no = ["licensed under clause license end", "licensed under the a b c clause license end", "licensed under license version end", "licensed under licence end", "licensed under"]
    assert all(a.match(x.encode().split(), 0) == len(x.split()) for x in yes)
    assert all(a.match(x.encode().split(), 0) == -1 for x in no)
    for bad in ("[[a]]", "{{x:1-2}} a", "a [[b"):
        with pytest.raises(ValueError):
            Automaton(bad)


def test_op9_components(spark, texts):
    import xxhash

    def fingerprint(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fp, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op9_simhash_vptree"](spark, SF).collect()}
    assert got == {i: (format(fp[i], "016x"), find(i)) for i in fp}


def test_op9_tree_search_is_exact(spark):
    """Clusters, chains and noise, in so many shards that balls cross their borders."""
    from siltstone.llm.common import connected_components
    from siltstone.llm.simhash_vptree import near_links

    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    flips = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for s in seeds[:60] for k in (1, 2, 3, 4, 5, 6)]
    chain = [seeds[0]]
    for b in range(0, 60, 4):
        chain.append(chain[-1] ^ np.uint64(0b1111 << b))
    fps = np.unique(np.concatenate([seeds, np.array(flips, np.uint64), np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    got = {r.node: r.root for r in connected_components(near_links(df, 4, 3, shard_size=8)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = fps.view(np.int64).copy()
    for _ in range(len(fps)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    linked = near.sum(1) > 1
    assert got == {int(f): int(x) for f, x, k in zip(fps.view(np.int64), label, linked, strict=True) if k}


@pytest.mark.parametrize("shard_size", [4, 64])
def test_op9_shards_of_any_size(spark, shard_size):
    """One shard with a cluster that spans it, chains and noise, split by trees of its own."""
    from siltstone.llm.simhash_vptree import block_masks, nested_links

    rng = np.random.default_rng(11)
    fps = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    bits = np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.bitwise_or.reduce(bits, axis=1), fps[0] ^ np.bitwise_or.reduce(bits[:300, :3], axis=1)]))
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for mask in block_masks(3):
        for a, b in zip(*nested_links(fps, 4, mask, 1, shard_size), strict=True):
            assert (int(a) ^ int(b)).bit_count() <= 64
            x, y = sorted((find(int(a)), find(int(b))))
            root[y] = x
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while (new := np.array([label[row].min() for row in near]).astype(int)).tolist() != label.tolist():
        label = new
    groups = {tuple(np.flatnonzero(label == k)) for k in set(label.tolist())}
    mine = collections.defaultdict(list)
    for i, x in enumerate(fps.view(np.int64)):
        mine[find(int(x))].append(i)
    assert groups == {tuple(g) for g in mine.values()}


def test_op9_hot_fingerprints_are_joined_whole(spark):
    from siltstone.llm.simhash_vptree import near_duplicates

    rows = [(i, "same words in very many texts" if i % 2 else f"text number {i} of its own with some words") for i in range(5000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 5000 and {r.component_id for r in got if r.doc_id % 2} == {1}


def test_op2_blocks_agree(spark, documents):
    from siltstone.llm.decontaminate import contamination

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents.unionByName(documents.filter("doc_id % 9 = 0"))
    for table in (documents, docs):  # the second with repeated rows
        # 25 words are fewer than some items have, so these are cut in pieces.
        whole, *blocks = (sorted(map(str, contamination(table, bench, block_words=n).collect())) for n in (10**6, 200, 25))
        assert all(whole == b for b in blocks) and any("contaminated=True" in r for r in whole)


def test_op3_spreads_a_large_group(spark):
    from siltstone.llm.exact_dedup import exact_duplicates

    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(900)] + [(5000, "same"), (5000, "same")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep="max", partitions=7).collect()
    same = [r for r in got if r.text_sha256 == hashlib.sha256(b"same").hexdigest()]
    assert len(same) == 602 and {(r.keep_id, r.group_size) for r in same} == {(5000, 602)} and sum(r.kept for r in same) == 1
    assert sum(r.kept for r in got) == 301
    low = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keep="min", partitions=7).filter("kept and group_size > 1").collect()
    assert [(r.doc_id, r.keep_id) for r in low] == [(1, 1)]


@pytest.mark.parametrize(("hot", "block"), [(3, 2048), (10**6, 2048), (10**6, 4), (3, 4)])
def test_op5_takes_hot_anchors_apart(spark, hot, block):
    """One passage in very many texts, other words beside it in each; also whole copies in many batches."""
    from siltstone.llm.suffix_dedup import remove_repeats

    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 180))
    rows = [(i, "".join(rng.choice(list("stuvwxyz "), 150)) + passage[i % 2 :] + "".join(rng.choice(list("stuvwxyz "), 150))) for i in range(40)]
    rows += [(100 + i, passage + rows[0][1][:120]) for i in range(20)]
    got = {r.doc_id: r.spans for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), hot=hot, rate=1, block=block).collect()}
    seen = set()
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 99):
            gone[p + 1 : p + 101] |= t[p : p + 100] in seen
            seen.add(t[p : p + 100])
        assert got[i] == np.flatnonzero(gone[1:] != gone[:-1]).tolist()


def test_op5_passage_in_a_third_of_all_texts(spark):
    """5,000 texts, by the windows' bytes themselves."""
    from siltstone.llm.suffix_dedup import remove_repeats

    rng = np.random.default_rng(4)
    letters = rng.choice(list("etaoin shrdlu"), (5000, 260))
    passage = "".join(rng.choice(list("abcdefgh "), 130))
    rows = [(i, "".join(x[:130]) + passage * (i % 3 == 0) + "".join(x[130:])) for i, x in enumerate(letters)]
    got = {r.doc_id: r.spans for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), hot=100, rate=4).collect()}
    seen = set()
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p + 1 : p + 101] = True
            else:
                seen.add(t[p : p + 100])
        assert got[i] == np.flatnonzero(gone[1:] != gone[:-1]).tolist()


def test_op5_compares_bytes():
    from siltstone.llm import suffix_dedup

    buf = np.frombuffer(b"x" * 100 + b"y" * 100 + bytes(8), np.uint8)
    raw = suffix_dedup._words_at(buf)
    assert suffix_dedup._same_bytes(raw, np.array([0, 0, 5]), np.array([1, 100, 95]), np.array([99, 100, 10])).tolist() == [True, False, False]
