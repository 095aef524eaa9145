import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import source_divergence as sd
from siltstone.llm.registry import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=10, top=10):
    """Rows from (lang, source, text), with dictionaries and Python's integers."""
    counts, held, in_docs = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = [x.translate(LOWER) for x in TERM.findall(text or "")]
        held[lang].add(source)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in held.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def share(own):
            whole = sum(own[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 2) // whole for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def read(df):
    return [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]


def test_trie_against_a_dictionary():
    rng = random.Random(2)
    trie, want = sd.RadixTrie(), {}
    for _ in range(5000):
        term = bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(7)))
        number = want.setdefault(term, len(want))
        assert trie.number(term, len(want) - (number == len(want) - 1)) == number
    assert list(trie.walk()) == sorted(want.items())


def test_shares_of_any_size():
    big = np.array([10**13, 0, 5 * 10**12], np.int64)
    assert sd.shares(big, 3 * 10**13).tolist() == [1 + 10**9 * (x + 2) // (3 * 10**13) for x in big.tolist()]
    assert sd.shares(np.array([[0, 7]]), np.array([4, 30])).tolist() == [[1 + 2 * 10**9 // 4, 1 + 9 * 10**9 // 30]]


def test_query(spark, documents, same):
    got = QUERIES["op13_source_divergence"](spark, "/root/testdata/sf0.001")
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert rows(got) == plain(read(documents))
    same(QUERIES["op13_source_divergence"], ORACLE_SQL["op13_source_divergence"])


@pytest.mark.parametrize("least", [1, 2, 10])
def test_odd_rows(spark, odd, empty, least):
    assert rows(sd.source_divergence(odd, least)) == plain(read(odd), least)
    assert sd.source_divergence(empty).count() == 0


def test_many_sources_ties_and_small_tries(spark, monkeypatch):
    """Blocks of few sources, tries that are written out again and again, one source with a third of the rows, and languages without kept terms or with one source."""
    monkeypatch.setattr(sd, "CELLS", 40)
    monkeypatch.setattr(sd, "LEAVES", 5)
    monkeypatch.setattr(sd, "SLICE", 100)
    rng = random.Random(4)
    docs = []
    for i in range(400):
        lang = rng.choice(["en", "en", "dé", None, ""])
        source = "hot" if i % 3 == 0 else rng.choice([*(f"s{j}" for j in range(15)), None, "é", "z\x00"])
        docs.append((lang, source, rng.choice([" ", "-", "\x00"]).join(rng.choice(["Tie", "tie", "tIe", "a", "A1b", "ÄÖ", "ä", "日本", "x y", "", "zz"]) for _ in range(rng.randrange(8)))))
    docs += [("one", "only", "a a a"), ("bare", "p", ""), ("bare", "q", None), ("bare", "r", "once")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    assert rows(sd.source_divergence(df)) == plain(docs)
