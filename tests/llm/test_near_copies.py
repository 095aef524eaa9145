"""Near copies against brute force over all pairs."""

import itertools

import numpy as np

import corpus_pipeline
from siltstone.llm import near_copies


def brute_force(rows):
    """Ids that stay: of each group of five-word Jaccard similarity of at least 0.8 the smallest."""

    def cut(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: cut(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(i for i in root if find(i) == i)


def made():
    """Copies with words changed (0.6 to 1.0 alike), chains, short texts, and a passage that many texts hold."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(4000)])
    passage, texts = list(rng.choice(words, 40)), []
    for k in range(40):
        base = list(rng.choice(words, int(rng.integers(6, 260))))
        texts.append(base if k % 3 else base + passage)
        for _ in range(6):
            base = list(base if rng.random() < 0.5 else texts[-1])
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                base[int(rng.integers(len(base)))] = str(rng.choice(words))
            texts.append(base)
    rows = [" ".join(t) for t in texts] + [None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_stage_keeps_what_brute_force_keeps(spark, documents, tmp_path):
    tables = made(), [(r.doc_id, r.text) for r in documents.collect()]
    for rows in tables:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect())
        want = brute_force(rows)
        assert got == want and len(want) < len(rows)


def test_groups_in_parts_give_the_same(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, parts = ({r.key for r in near_copies.copies_to_drop(df, part=part).collect()} for part in (near_copies.PART, 3000))
    keys = {r.key: r.doc_id for r in df.select("doc_id", near_copies.row_key().alias("key")).collect()}
    assert whole == parts and sorted(i for k, i in keys.items() if k not in parts) == brute_force(rows)


def test_dense_group_needs_few_comparisons():
    rng = np.random.default_rng(1)
    base = np.arange(500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[10:], rng.integers(1000, 1 << 40, 10).astype(np.uint64)])) for _ in range(3000)]
    assert (near_copies.similar_groups(sets) == 0).all()


def template_pages(n, shared, own):
    """Pages of words of a template, which all have, and some of their own."""
    return [(i, " ".join([f"t{j}" for j in range(shared)] + [f"p{i}x{j}" for j in range(own)])) for i in range(n)]


def test_a_template_links_only_pages_that_are_alike(spark):
    """800 pages share 210 shingles: with 50 of their own none is linked to any other, with 20 of their own all are alike."""

    def links(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        sets = [near_copies.shingles(t.encode()) for _, t in rows]
        classes = spark.createDataFrame([(i.to_bytes(16, "little"), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node binary, hashes binary")
        held = spark.sparkContext.broadcast(near_copies.common_shingles(classes))
        heads = classes.mapInArrow(near_copies._prefixes(held), near_copies._HEAD_DDL)
        return near_copies.candidate_stars(heads).count(), near_copies.copies_to_drop(docs).count()

    assert links(template_pages(800, 214, 46)) == (0, 0)
    found, dropped = links(template_pages(800, 214, 16))
    assert found > 0 and dropped == 799


def test_pages_of_many_sizes(spark, tmp_path):
    """Templates with so many own words that some pages are alike and others aren't, of the same sizes."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        template, own = int(rng.integers(2)), int(rng.integers(0, 60))
        words = [f"t{template}x{j}" for j in range(int(rng.integers(150, 200)))] + [f"p{i if rng.random() < 0.5 else i // 3}x{j}" for j in range(own)]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_force(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()) == want and 1 < len(want) < 150


def test_prefixes_hold_a_shingle_that_both_may_have_first():
    rng = np.random.default_rng(2)
    common = np.sort(rng.choice(400, 120, replace=False)).astype(np.uint64)
    counts = rng.integers(2, 50, 120)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.choice(400, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, len(x) - int(rng.integers(0, 6))), replace=False), rng.choice(400, int(rng.integers(0, 6))).astype(np.uint64)]))
        if 5 * len(np.intersect1d(x, y)) < 4 * len(np.union1d(x, y)):
            continue
        (hx, rx), (hy, ry) = (near_copies.ordered_prefix(s, common, counts) for s in (x, y))
        a, b = dict(zip(hx.tolist(), rx.tolist(), strict=True)), dict(zip(hy.tolist(), ry.tolist(), strict=True))
        assert any(a[h] >= len(y) and b[h] >= len(x) for h in a.keys() & b.keys())


def test_fingerprints_of_all_rows_give_the_first_links(spark, monkeypatch, tmp_path):
    """Without the exact candidates the stage still finds what the trees link, of all rows, and drops no unlike ones."""
    rows = made()
    seen, operator = [], near_copies.near_duplicates

    def counted(docs, *args, **kwargs):
        seen.append(docs.count())
        return operator(docs, *args, **kwargs)

    monkeypatch.setattr(near_copies, "near_duplicates", counted, raising=False)
    real = near_copies.candidate_stars
    monkeypatch.setattr(near_copies, "candidate_stars", lambda heads: real(heads).filter("false"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()}
    equal = {}
    for i, t in rows:
        equal.setdefault(frozenset(near_copies.shingles((t or "").encode()).tolist()), []).append(i)
    assert seen == [len(rows)] and set(brute_force(rows)) <= got and len(got) < len(equal)


def test_what_fingerprints_connect_is_one_group(spark):
    """A set that is like one member of a known group comes into it; two known groups stay apart unless a pair is alike."""
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a + np.uint64(30), a + np.uint64(1), a + np.uint64(35), a + np.uint64(900), a + np.uint64(950)]
    assert near_copies.similar_groups(sets, np.array([0, 0, -1, -1, 1, 1])).tolist() == [0, 0, 0, 0, 4, 4]
    linked = spark.createDataFrame([(b"a", b"r"), (b"b", b"r"), (b"c", b"s"), (b"d", b"s"), (b"e", b"t"), (b"f", b"t")], "node binary, root binary")
    known = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"c", b"c"), (b"e", b"e"), (b"f", b"f")], "node binary, known binary")
    assert {bytes(r.node) for r in near_copies.open_groups(linked, known).collect()} == {b"c", b"d", b"e", b"f"}
