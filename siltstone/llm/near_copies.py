"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

SimHash fingerprints of all rows, joined through vantage-point trees (``simhash_vptree``), give the first links; they are
held against the sets, and what is connected then isn't compared again.  Fingerprints of similar texts often differ in
more bits than a tree can be searched for, so the rest is found in an exact way.

Two similar sets share four fifths of either one.  So a text stays in the race only if four fifths of its shingles occur in
some other text too, which a count over all shingles, packed in blocks, finds out; most texts end there.  Of the others,
two similar ones share a shingle among the rarest fifth (and one more) of each.  A shingle's place in that order says how
large a set can be with which it is the first in common, so the sets of a shingle fall into runs that can't hold similar
ones, and a template that many pages share links none of them unless they are alike in the rest.  Sets of one run are
linked, and each connected group of links goes to one task, where the similarities are worked out and groups are grown
from text to text.  A group of more than ``PART`` bytes is cut into parts, and any two of these go to a task, so what a
task holds is bounded.  No pair is missed, and no pairs are written out: tasks give stars, which are connected.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, connected_components, join_counted, lean, shuffle_partitions, staged, text_slices
from siltstone.llm.simhash_vptree import near_duplicates

SHINGLE = 5
NUM, DEN = 4, 5  # the similarity, as a fraction
DISTANCE = 5  # bits in which linked fingerprints may differ: at most one in some block of three, as with four
BUCKET = 16 << 20  # characters of text whose shingles make one bucket
PART = 16 << 20  # bytes of the sets that are compared as one part of a group
BROADCAST = 1_000_000  # keys that are sent to all executors
RATE, COMMON = 16, 2_000_000  # one set in so many tells which shingles are common; so many of these are sent to all executors


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, in order; ASCII case folded.  A text of fewer words is one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    cut = map(line.__getitem__, map(slice, starts, ends[size - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(starts)))


def prefix(n: int) -> int:
    """How many shingles of a set of ``n``, in any order common to all sets, hold one of each similar set."""
    return n - -(-NUM * n // DEN) + 1


_BLOCK_DDL = "bucket int, hashes binary, owners binary, keys binary, sizes binary"
_BLOCK = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("hashes", "owners", "keys", "sizes")])


def _blocks(buckets: int):
    """Shingles by bucket: half a hash and the owner's key for each; a text's size goes to one of the buckets."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 4 << 20):
                keys, sets = part.column(0).to_numpy(), [shingles(t) for t in byte_texts(part, 1)]
                sizes = np.array([len(s) for s in sets], "<u4")
                hashes, owners = np.concatenate(sets), np.repeat(keys, sizes)
                at, home = (hashes % np.uint64(buckets)).astype(np.int32), (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                by, by_home = np.argsort(at, kind="stable"), np.argsort(home, kind="stable")
                there = np.union1d(at, home)  # a slice has few of very many buckets
                cut, cut_home = (np.searchsorted(x, there) for x in (at[by], home[by_home]))
                end, end_home = (np.searchsorted(x, there, side="right") for x in (at[by], home[by_home]))
                hashes, owners, keys, sizes = (hashes[by] >> np.uint64(32)).astype("<u4"), owners[by], keys[by_home], sizes[by_home]
                rows = [(b, hashes[i:j].tobytes(), owners[i:j].tobytes(), keys[k:m].tobytes(), sizes[k:m].tobytes()) for b, i, j, k, m in zip(there.tolist(), cut, end, cut_home, end_home, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)

    return run


_COUNT = pa.schema([("home", pa.int32())] + [(n, pa.binary()) for n in ("keys", "shared", "sizes")])
_COUNT_DDL = "home int, keys binary, shared binary, sizes binary"


def _by_bucket(batches, columns: int):
    """Rows sorted by their first column, a bucket: the rows of each."""
    held: list = []
    for batch in batches:
        for part in text_slices(batch, 1, 1 << 20):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield [[r[i] for r in held] for i in range(columns)]
                    held = []
                held.append(row)
    if held:
        yield [[r[i] for r in held] for i in range(columns)]


def _shared(buckets: int):
    """For each bucket and text, how many shingles have another owner too; packed by the texts' homes."""

    def run(batches):
        for _, hashes, owners, keys, sizes in _by_bucket(batches, 5):
            h, owners = np.frombuffer(b"".join(hashes), "<u4"), np.frombuffer(b"".join(owners), "<i8")
            by = np.argsort(h)
            h = h[by]
            same = h[1:] == h[:-1]
            own, n = np.unique(owners[by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(h) else owners, return_counts=True)
            del h, owners, by, same
            keys, sizes = np.frombuffer(b"".join(keys), "<i8"), np.frombuffer(b"".join(sizes), "<u4")
            columns = np.concatenate([own, keys]), np.concatenate([n, np.zeros(len(keys), np.int64)]).astype("<u4"), np.concatenate([np.zeros(len(own), "<u4"), sizes])
            home = (columns[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(home, kind="stable")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(home[by]) != 0])), len(by)) if len(by) else np.zeros(1, np.int64)
            rows = [(int(home[by[i]]), *(c[by[i:j]].tobytes() for c in columns)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COUNT.types, strict=True)], schema=_COUNT)

    return run


def _raced(batches):
    """Texts of which four fifths of the shingles have another owner."""
    schema = pa.schema([("key", pa.int64())])
    for _, keys, shared, sizes in _by_bucket(batches, 4):
        key, at = np.unique(np.frombuffer(b"".join(keys), "<i8"), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(shared), "<u4"), len(key))
        size = np.zeros(len(key), np.int64)
        np.maximum.at(size, at, np.frombuffer(b"".join(sizes), "<u4").astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key[n * DEN >= size * NUM])], schema=schema)


_SET = pa.schema([("node", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("hashes", pa.binary())])


def _sets(batches):
    for batch in batches:
        for part in text_slices(batch, 1, 2 << 20):
            sets = [shingles(t).tobytes() for t in byte_texts(part, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), part.column(2), part.column(0), pa.array(sets, pa.binary())], schema=_SET)


def _sampled(rate: int):
    """Shingles of one set in ``rate``."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 2 << 20):
                for node, blob in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if int.from_bytes(node[:8], "little") % rate == 0:
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64))], schema=schema)

    return run


def common_shingles(classes: DataFrame, rate: int = RATE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two sets or more of a sample hold (one set in ``rate``), in order, and how many do; the ``most`` commonest at most.

    This only orders shingles: whatever it says, all sets are ordered alike.
    """
    counts = classes.select("node", "hashes").mapInArrow(lean(_sampled(rate)), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    found = counts.orderBy(F.col("n").desc(), "h").limit(most).toPandas()
    order = np.argsort(found["h"].to_numpy(np.int64).view(np.uint64), kind="stable")
    return found["h"].to_numpy(np.int64).view(np.uint64)[order], found["n"].to_numpy(np.int64)[order]


_HEAD = pa.schema([("h", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("reach", pa.int64())])
_HEAD_DDL = "h long, node binary, size long, reach long"


def ordered_prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's prefix, the rarest shingles first, and for each of them its reach.

    The reach is the largest set with which this shingle can be the first in common: what is behind it in both orders
    must hold the overlap that a similarity of 0.8 asks for, which grows with both sizes.
    """
    n = len(hashes)
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    seen = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    head = hashes[np.lexsort((hashes, seen))[: prefix(n)]]
    return head, (NUM + DEN) * (n - np.arange(len(head))) // NUM - n


def _prefixes(held):
    def run(batches):
        common, counts = held.value
        for batch in batches:
            for part in text_slices(batch, 1, 2 << 20):
                for node, blob in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    hashes = np.frombuffer(blob, np.uint64)
                    h, reach = ordered_prefix(hashes, common, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(repeat(node, len(h)), pa.binary()), pa.array(np.full(len(h), len(hashes), np.int64)), pa.array(reach)], schema=_HEAD)

    return run


def candidate_stars(heads: DataFrame) -> DataFrame:
    """``h, size, a``: for each shingle and size of set, the node that stands for all sets it may be similar to.

    Along the sizes of a shingle's sets a new run begins where no smaller set reaches: sets of different runs can't have
    this shingle as their first in common.  Runs of one set are left out.  Counts come from partial sums, one row for
    each shingle and size, so a shingle of very many sets isn't gathered anywhere.
    """
    by_size = heads.groupBy("h", "size").agg(F.max("reach").alias("reach"), F.min("node").alias("a"), F.count("*").alias("n"))
    before = Window.partitionBy("h").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # Sets of one size meet if one of them reaches its own size; a lone set meets only others.
    own = (F.col("n") > 1) & (F.col("reach") >= F.col("size"))
    apart = by_size.withColumn("new", ~F.coalesce(F.max("reach").over(before) >= F.col("size"), F.lit(False)))
    runs = apart.withColumn("run", F.count_if("new").over(Window.partitionBy("h").orderBy("size"))).withColumn("own", own)
    w = Window.partitionBy("h", "run")
    runs = runs.withColumn("all", F.count("*").over(w)).filter((F.col("all") > 1) | F.col("own"))
    return runs.select("h", "size", F.min("a").over(w).alias("a"), "n")


def similar_groups(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first one of its group; groups are what similar pairs connect.

    Candidates come from an index of the rarest shingles of each set.  What is in a group is looked at no more and
    leaves the index, so a dense group of n sets takes some multiple of n comparisons and not n squared.
    Sets with the same number in ``known`` (-1: none) are connected already and come into a group together.
    """
    sizes = np.array([len(s) for s in sets])
    known = np.full(len(sets), -1) if known is None else known
    order = np.argsort(known, kind="stable")
    ranked = known[order]

    def with_known(i):
        if known[i] < 0:
            return [i]
        lo, hi = np.searchsorted(ranked, known[i]), np.searchsorted(ranked, known[i], side="right")
        return order[lo:hi].tolist()

    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    tokens = [np.sort(t) for t in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    heads = [t[: prefix(len(t))] for t in tokens]
    group, left, mark = np.arange(len(sets)), np.ones(len(sets), bool), np.zeros(len(counts), bool)

    def index():
        who = np.flatnonzero(left)
        token, owner = np.concatenate([heads[i] for i in who]), np.repeat(who, [len(heads[i]) for i in who])
        by = np.argsort(token, kind="stable")
        return token[by], owner[by], len(who)

    token, owner, indexed = index()
    n_left = len(sets)
    for start in range(len(sets)):
        if not left[start]:
            continue
        todo = with_known(start)
        left[todo], group[todo] = False, start
        n_left -= len(todo)
        while todo and n_left:
            if n_left * 2 < indexed:
                token, owner, indexed = index()
            i = todo.pop()
            lo, hi = np.searchsorted(token, heads[i]), np.searchsorted(token, heads[i], side="right")
            near = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]))
            near = near[left[near] & (DEN * np.minimum(sizes[near], sizes[i]) >= NUM * np.maximum(sizes[near], sizes[i]))]
            mark[tokens[i]] = True
            for j in near.tolist():
                if left[j] and (NUM + DEN) * np.count_nonzero(mark[tokens[j]]) >= NUM * (sizes[i] + sizes[j]):
                    come = with_known(j)
                    left[come], group[come] = False, start
                    n_left -= len(come)
                    todo += come
            mark[tokens[i]] = False
    return group


def _verify(batches):
    schema = pa.schema([("node", pa.binary()), ("first", pa.binary())])

    def emit(nodes, blobs, known):
        numbers = {k: i for i, k in enumerate(dict.fromkeys(k for k in known if k is not None))}
        group = similar_groups([np.frombuffer(b, np.uint64) for b in blobs], np.array([numbers.get(k, -1) for k in known]))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([nodes[g] for g in group], pa.binary())], schema=schema)

    root, nodes, blobs, known = None, [], [], []
    for batch in batches:
        for part in text_slices(batch, 2, 2 << 20):
            for r, node, blob, k in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if r != root and nodes:
                    yield emit(nodes, blobs, known)
                    nodes, blobs, known = [], [], []
                root = r
                nodes.append(node)
                blobs.append(blob)
                known.append(k)
    if nodes:
        yield emit(nodes, blobs, known)


def few(keys: DataFrame) -> DataFrame:
    """A staged table of keys, to be broadcast unless it is large."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _in_parts(linked: DataFrame, classes: DataFrame, part: int) -> DataFrame:
    """``key, node, hashes, known``: the sets that are compared with each other have a key in common.

    A group of one part has one key; of others each pair of parts has one, so sets of one part meet there too.
    """
    sizes = linked.join(classes.select("node", "bytes"), "node").groupBy("root").agg(F.ceil(F.sum("bytes") / part).alias("parts"), F.count("*").alias("n"))
    located = join_counted(linked, staged(sizes, "parts"), "root").withColumn("own", F.expr("pmod(xxhash64(node), parts)"))
    rows = located.join(classes.select("node", "hashes"), "node")
    rows = rows.select("*", F.explode(F.expr("if(parts = 1, array(0L), filter(sequence(0L, parts - 1), i -> i <> own))")).alias("other"))
    digits = [F.unhex(F.lpad(F.hex(pick("own", "other")), 16, "0")) for pick in (F.least, F.greatest)]
    return rows.select(F.concat("root", *digits).alias("key"), "node", "hashes", "known")


def _alike(linked: DataFrame, classes: DataFrame, part: int) -> DataFrame:
    """Stars ``a, b`` of the similar sets in groups ``node, root, known``."""
    dealt = _in_parts(linked, classes, part).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(_verify), "node binary, first binary").select(F.col("first").alias("a"), F.col("node").alias("b"))


def fingerprint_groups(near: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root, known``: the sets of each component of fingerprints (``key, near``) that has two or more of them."""
    root = F.unhex(F.lpad(F.hex("near"), 16, "0")).alias("root")
    pairs = staged(sets.select("key", "node").distinct().join(near.distinct(), "key").select("node", root).distinct(), "fingerprinted")
    several = staged(pairs.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    return join_counted(pairs, several, "root").select("node", "root", F.lit(None).cast("binary").alias("known"))


def open_groups(linked: DataFrame, known: DataFrame) -> DataFrame:
    """``node, root, known``: the groups of candidates that ``known`` (``node, known``) doesn't connect as a whole."""
    marked = staged(linked.join(known, "node", "left"), "marked")
    whole = (F.min("known") == F.max("known")) & (F.count("known") == F.count("*"))
    left = staged(marked.groupBy("root").agg(F.count("*").alias("n"), F.coalesce(whole, F.lit(False)).alias("whole")).filter("not whole").select("root", "n"), "open")
    return join_counted(marked, left, "root").select("node", "root", "known")


def copies_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """``key`` (see ``row_key``) and ``doc_id`` of each row that isn't the one with the smallest id of its group of near copies.

    Groups are what pairs with a Jaccard similarity of at least 0.8 connect.  Null and empty texts are alike.  A null id
    counts as the largest; of several texts under the smallest id one stays.  Repeated rows share their key.
    """
    d = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    near = staged(near_duplicates(d.select("key", "text"), "key", "text", max_distance=DISTANCE).select(F.col("doc_id").alias("key"), F.col("component_id").alias("near")), "near")
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-chars // BUCKET))
    blocks = d.select("key", "text").mapInArrow(lean(_blocks(buckets)), _BLOCK_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = blocks.mapInArrow(lean(_shared(buckets)), _COUNT_DDL).repartition(buckets, "home").sortWithinPartitions("home")
    raced = staged(counts.mapInArrow(lean(_raced), "key long"), "raced")
    sets = staged(d.join(few(raced), "key", "left_semi").select("key", "text", "doc_id").mapInArrow(lean(_sets), "node binary, doc_id long, key long, hashes binary"), "sets")
    classes = staged(sets.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first(F.octet_length("hashes")).alias("bytes"), F.count("*").alias("n")), "classes")
    first = staged(_alike(staged(fingerprint_groups(near, sets), "by_fingerprint"), classes, part), "first")
    known = staged(first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("known")), "known")  # one star of each set
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(classes))
    heads = staged(classes.select("node", "hashes").mapInArrow(lean(_prefixes(held)), _HEAD_DDL).withColumn("place", F.struct("h", "size")), "prefixes")
    stars = staged(candidate_stars(heads).select(F.struct("h", "size").alias("place"), "a", "n"), "least")
    links = join_counted(heads.select("place", "node"), stars, "place").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    linked = staged(open_groups(connected_components(links, "copies"), known), "linked")
    stars = _alike(linked, classes, part).unionByName(first)
    alike = connected_components(stars, "alike").withColumnRenamed("root", "first")
    named = staged(classes.select("node", "n").join(alike, "node", "left").select("node", F.coalesce("first", "node").alias("first"), "n"), "named")
    rows = staged(join_counted(sets.select("node", "key", "doc_id"), named, "node").select("key", "doc_id", "first"), "groups")
    best = rows.groupBy("first").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"), F.count("*").alias("n"))
    best = staged(best.select("first", F.col("best.key").alias("best"), F.col("best.doc_id").alias("best_id"), "n"), "best")
    kept = (F.col("key") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    return staged(join_counted(rows, best, "first").filter(~kept).select("key", "doc_id").distinct(), "dropped")
