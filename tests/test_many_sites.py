"""Snapshots under several writers, walks in queue order, many sites in one run, incremental ingestion."""

import random
import threading
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import GapCrawl, Registry, Site
from siltstone.operators import frontier, hosts, ingestion, manifest, presence, trust
from siltstone.plans import pipelines
from siltstone.sources.snapshots import BucketedSnapshots, Conflict, Snapshots

NOW = datetime(2026, 8, 5)
NUMBERS = T.StructType([T.StructField("n", T.LongType())])
DDL = "url string, status int, body string, error boolean, retry_after string"


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def test_a_late_writer_fails_and_loses_nothing(spark, tmp_path):
    held = Snapshots(spark, f"file://{tmp_path}/t", NUMBERS)
    held.write(spark.range(1).toDF("n"))
    base = held.versions()[-1]  # writer B looks
    held.update(lambda t: t.unionByName(spark.range(1, 2).toDF("n")))  # writer A commits
    with pytest.raises(Conflict):
        held.write(held.read(base).unionByName(spark.range(2, 3).toDF("n")), base)
    assert held.versions() == [1, 2] and sorted(r.n for r in held.read().collect()) == [0, 1]
    tries = []

    def change(t):
        tries.append(1)
        if len(tries) == 1:  # another writer is faster just now
            held.update(lambda u: u.unionByName(spark.range(5, 6).toDF("n")))
        return t.unionByName(spark.range(2, 3).toDF("n"))

    assert held.update(change) == 4 and len(tries) == 2
    assert sorted(r.n for r in held.read().collect()) == [0, 1, 2, 5]
    with pytest.raises(Conflict):
        held.update(lambda t: (held.write(t), t)[1], tries=2)


def test_writers_at_once_keep_all_rows(spark, tmp_path):
    held = Snapshots(spark, f"file://{tmp_path}/t", NUMBERS)
    held.write(spark.range(1).toDF("n"))

    def add(k):
        for i in range(3):
            held.update(lambda t, i=i: t.unionByName(spark.range(10 * k + i, 10 * k + i + 1).toDF("n")), tries=30)

    threads = [threading.Thread(target=add, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.n for r in held.read().collect()) == [0, 10, 11, 12, 20, 21, 22] and held.versions()[-1] == 7
    held.expire(1, older_than_seconds=3600)
    assert len(held.versions()) == 7
    held.expire(1)
    assert held.versions() == [7]


def test_an_update_writes_the_buckets_it_touches(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    held = BucketedSnapshots(spark, f"file://{tmp_path}/t", schema, ("k",), 16)
    assert held.read().count() == 0 and held.versions() == []
    held.update(lambda t: spark.range(200).selectExpr("id as k", "0L as v"))

    def put(keys, v):
        fresh = spark.createDataFrame([(k, v) for k in keys], schema)
        return held.update(lambda t: t.join(fresh, "k", "left_anti").unionByName(fresh), touching=fresh)

    before = held._folders(1)
    assert put([5, 1000], 7) == 2
    after = held._folders(2)
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2 and len(before) == 16
    assert {(r.k, r.v) for r in held.read().collect()} == {(k, 7 if k == 5 else 0) for k in range(200)} | {(1000, 7)}
    gone = spark.createDataFrame([(1000,)], "k long")
    held.update(lambda t: t.join(gone, "k", "left_anti"), touching=gone)
    assert held.read().count() == 200 and held.read(2).count() == 201

    def late(t):
        if held.versions()[-1] == 3:  # another writer is faster
            put([6], 9)
        return t.filter("k <> 5")

    assert held.update(late, touching=spark.createDataFrame([(5,)], "k long")) == 5
    assert {r.k: r.v for r in held.read().filter("k in (5, 6)").collect()} == {6: 9} and held.read().count() == 199
    held.expire(1)
    assert held.versions() == [5] and held.read().count() == 199
    files = [p for p in (tmp_path / "t/_data").glob("*/bucket=*")]
    assert len(files) == len(held._folders(5)) == 16


def queue(links, seeds, budget, depth):
    """The plain loop: first in, first out."""
    out, seen, waiting, cut = [], set(), deque((s, 0) for s in seeds), False
    while waiting:
        node, d = waiting.popleft()
        if node in seen:
            continue
        if budget is not None and len(out) >= budget:
            cut = True
            break
        seen.add(node)
        out.append((node, d))
        if depth is None or d < depth:
            waiting.extend((x, d + 1) for x in links.get(node, ()))
    return out, cut


def test_walks_are_those_of_a_queue(spark):
    rng = random.Random(6)
    links = {i: [rng.randrange(60) for _ in range(rng.randrange(5))] for i in range(60)}
    edges = spark.createDataFrame([(a, b, i) for a, found in links.items() for i, b in enumerate(found)] + [(None, 1, 0), (1, None, 0)], "src long, dst long, pos long").repartition(3)
    sites = {"a": ([3, 7, 3], 20, None), "b": ([9], None, 2), "c": ([0, 1], 5, 3), "d": ([30, 31, 32], 2, None), "e": ([5], None, None)}
    seeds = spark.createDataFrame([(s, n, i) for s, (start, _, _) in sites.items() for i, n in enumerate(start)], "site_name string, node long, pos long")
    limits = spark.createDataFrame([(s, b, d) for s, (_, b, d) in sites.items()], "site_name string, budget long, max_depth int")
    reached, cut = frontier.walk_sites(edges, seeds, limits)
    got = {}
    for r in reached.orderBy("site_name", "depth", "place").collect():
        got.setdefault(r.site_name, []).append((r.node, r.depth))
    want = {s: queue(links, *v) for s, v in sites.items()}
    assert got == {s: w for s, (w, _) in want.items()}
    assert {r.site_name for r in cut.collect()} == {s for s, (_, c) in want.items() if c}
    free, _ = frontier.walk_sites(edges, seeds.filter("site_name = 'e'"))
    assert [(r.node, r.depth) for r in free.orderBy("depth", "place").collect()] == want["e"][0]
    own = edges.crossJoin(spark.createDataFrame([("a",)], "site_name string"))  # links of one site alone
    assert {r.site_name for r in frontier.walk_sites(own, seeds, limits, max_depth=1)[0].filter("depth = 1").collect()} == {"a"}


def test_many_sites_in_one_run(spark, tmp_path):
    a, b, c = "https://a.example", "https://b.example", "https://c.example"
    registry = Registry(
        [
            Site("a", a, sitemap_urls=(f"{a}/s.xml",), exclude_url_patterns=("*/x/*",)),
            Site("b", b + "/start/", allowed_domains=("B.example",), cache_ttl_hours=0),
            Site("c", c, sitemap_urls=(f"{c}/s.xml",), min_delay=0.5, max_delay=0.5),
            Site("g", a, discovery_source="none", allowed_domains=("a.example",), gap_crawl=GapCrawl(True, (f"{a}/",), 1, 3)),
        ]
    )
    rows = [
        (f"{a}/robots.txt", 404, "", False, None),
        # b.xml before a.xml: what a.xml says counts, as it is read last.
        (f"{a}/s.xml", 200, index(f"{a}/b.xml", f"{a}/a.xml"), False, None),
        (f"{a}/b.xml", 200, f"<urlset><url><loc>{a}/p</loc><lastmod>2026-01-01</lastmod></url></urlset>", False, None),
        (f"{a}/a.xml", 200, f"<urlset><url><loc>{a}/p</loc><lastmod>2026-02-02</lastmod></url><url><loc>{a}/x/1</loc></url></urlset>", False, None),
        (f"{b}/robots.txt", 200, f"User-agent: *\nCrawl-delay: 4\nSitemap: {b}/s.xml", False, None),
        (f"{b}/s.xml", 200, urlset(f"{b}/1", f"{b}/2", f"{a}/elsewhere"), False, None),
        (f"{c}/robots.txt", 503, "", False, "4000"),
    ]
    responses = spark.createDataFrame(rows, DDL)
    links = spark.createDataFrame([(f"{a}/", f"{a}/9", 0), (f"{a}/", f"{a}/1", 1), (f"{a}/", f"{a}/5", 2), (f"{a}/9", f"{a}/deep", 0)], "src string, dst string, pos int")
    held, runs = Snapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA), Snapshots(spark, f"file://{tmp_path}/r", T.StructType.fromDDL(pipelines.RUNS))
    out = {}
    for r in pipelines.discover_sites(spark, registry, held, runs, responses, F.lit(NOW), links).collect():
        out.setdefault(r.site_name, {})[r.metric] = r.n
        out[r.site_name] |= {"complete": r.complete, "cached": r.cached, "delays": (r.min_delay, r.max_delay)}
    assert out == {
        "a": {"discovered": 3, "eligible": 2, "excluded:excluded_by_pattern": 1, "complete": True, "cached": False, "delays": (1.0, 3.0)},
        "b": {"discovered": 3, "eligible": 2, "excluded:domain_not_allowed": 1, "complete": True, "cached": False, "delays": (4.0, 4.0)},
        "c": {"discovered": 0, "eligible": 0, "complete": False, "cached": False, "delays": (0.5, 0.5)},
        "g": {"discovered": 3, "eligible": 3, "complete": False, "cached": False, "delays": (1.0, 3.0)} | {"complete": True},
    }
    m = {(r.site_name, r.canonical_url): r for r in held.read().collect()}
    assert m["a", f"{a}/p"].sitemap_lastmod == datetime(2026, 2, 2) and {u for s, u in m if s == "g"} == {f"{a}/", f"{a}/9", f"{a}/1"}
    assert {r.site_name: r.complete for r in runs.read().collect()} == {"a": True, "b": True, "c": False}
    again = {(r.site_name, r.metric): (r.n, r.cached) for r in pipelines.discover_sites(spark, registry, held, runs, responses, F.lit(NOW + timedelta(hours=1)), links).collect()}
    assert again["a", "discovered"] == (2, True) and again["b", "discovered"] == (3, False)

    due = pipelines.plan_render(held.read(), registry, F.lit(NOW), 2)
    assert {(r.site_name, r.canonical_url, r["rank"]) for r in due.collect()} == {("a", f"{a}/p", 1), ("b", f"{b}/1", 1), ("b", f"{b}/2", 2), ("g", f"{a}/", 1), ("g", f"{a}/1", 2)}
    # One address in two sites; each record is judged by its own site.
    words = "useful words here " * 20
    moved = [("a", f"{a}/p", f"{a}/x/2"), ("b", f"{b}/1", f"{a}/y"), ("b", f"{b}/2", f"{b}/2"), ("g", f"{a}/", f"{a}/x/2"), ("g", f"{a}/1", f"{a}/1")]
    ddl = "site_name string, canonical_url string, success boolean, exception boolean, status_code int, cache_status string, fit_markdown string, raw_markdown string, meta_url string, url string, title string, fallback_success boolean, fallback_fit_markdown string, fallback_raw_markdown string, fallback_meta_url string, fallback_url string, fallback_title string"
    results = spark.createDataFrame([(s, u, True, False, 200, "miss", words, "", None, to, "T", False, None, None, None, None, None) for s, u, to in moved], ddl)
    counted = Snapshots(spark, f"file://{tmp_path}/c", T.StructType.fromDDL(pipelines.METRICS))
    rows = pipelines.apply_render(held, due, results, registry, F.lit(NOW), metrics=counted, run_id="x")
    assert {(r.site_name, r.n) for r in counted.read().filter("metric = 'saved' and run_id = 'x' and phase = 'render'").collect()} == {("a", 0), ("b", 1), ("g", 2)}
    assert {(r.site_name, r.canonical_url): r.outcome for r in rows.collect()} == {("a", f"{a}/p"): "failure", ("b", f"{b}/1"): "failure", ("b", f"{b}/2"): "saved", ("g", f"{a}/"): "rekeyed", ("g", f"{a}/1"): "saved"}
    # c's host asked for more than the cap: what waits there is incomplete for this run.
    sites = registry.table(spark).withColumn("delay", F.col("min_delay"))
    log = hosts.discovery_requests(sites.filter("site_name in ('b', 'c')"), spark.createDataFrame([("b", f"{b}/s.xml", 0, 1)], "site_name string, node string, depth int, place long"), responses, F.lit(NOW))
    waiting = spark.createDataFrame([("c", f"{c}/1", f"{c}/1", 1), ("b", f"{b}/1", f"{b}/1", 1), ("b", f"{b}/2", f"{b}/2", 2)], "site_name string, canonical_url string, source_url string, rank int")
    slots = {r.canonical_url: ((r.starts_at - NOW).total_seconds(), r.incomplete) for r in hosts.render_slots(waiting, log, sites, F.lit(NOW), F.lit(3.0)).collect()}
    assert slots == {f"{c}/1": (3600.0, True), f"{b}/1": (2.0, False), f"{b}/2": (3.0, False)}


def test_sites_without_responses_are_incomplete(spark, tmp_path):
    held, runs = Snapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA), Snapshots(spark, f"file://{tmp_path}/r", T.StructType.fromDDL(pipelines.RUNS))
    out = pipelines.discover(spark, Site("a", "https://a.example", sitemap_urls=("https://a.example/s.xml",)), held, runs, None, F.lit(NOW)).collect()
    assert {r.metric: (r.n, r.complete) for r in out} == {"discovered": (0, False), "eligible": (0, False)}


def test_only_changed_files_are_embedded(spark, tmp_path):
    root, asked = tmp_path / "content", tmp_path / "asked"
    asked.mkdir()

    def embedder(texts):
        import os
        import uuid

        import numpy as np

        for _ in texts:
            with open(os.path.join(str(asked), uuid.uuid4().hex), "w"):
                pass
        return np.zeros((len(texts), 2), np.float32)

    def put(name, text):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    def count():
        n = len(list(asked.iterdir()))
        for f in asked.iterdir():
            f.unlink()
        return n

    held, ledger = (Snapshots(spark, f"file://{tmp_path}/{n}", T.StructType.fromDDL(ddl)) for n, ddl in (("chunks", ingestion.CHUNKS), ("ledger", ingestion.LEDGER)))

    def run(day, **more):
        rows = pipelines.ingest_tree(spark, str(root), held, ledger, F.lit(NOW + timedelta(days=day)), embedder=embedder, model="none", **more).collect()
        return {r.path.rsplit("/", 1)[-1]: (r.change, r.chunks) for r in rows}

    put("s/parsed/a.md", "---\ntitle: A\nlanguage: fi\ncanonical_url: https://a.example/a\nsource_url: https://a.example/A\n---\n" + "word " * 500)
    put("s/parsed/b.md", "plain text")
    put("t/parsed/c.md", "---\na: [\n---\nx")
    first = run(0)
    assert first["a.md"][0] == first["b.md"][0] == "added" and first["c.md"] == ("added", 0) and count() == first["a.md"][1] + 1 >= 4
    head = held.read().filter("file_name = 'a.md'").first()["head"]
    assert head["language"] == "fi" and head["canonical_url"] == "https://a.example/a" and head["citation_url"] == "https://a.example/A" and head["source_id"] == "a"
    assert run(1) == {"a.md": ("unchanged", first["a.md"][1]), "b.md": ("unchanged", 1), "c.md": ("unchanged", 0)} and count() == 0
    put("s/parsed/a.md", "short now")  # it shrinks: its old chunks go
    put("t/parsed/d.md", "new")
    (root / "s/parsed/b.md").unlink()
    assert run(2) == {"a.md": ("changed", 1), "b.md": ("dropped", 0), "c.md": ("unchanged", 0), "d.md": ("added", 1)} and count() == 2
    assert sorted(r.page_content for r in held.read().collect()) == ["new", "short now"]
    gone = ledger.read().filter("deleted_at is not null").collect()
    assert [r.path.rsplit("/", 1)[-1] for r in gone] == ["b.md"] and gone[0].deleted_at == NOW + timedelta(days=2)
    put("s/parsed/b.md", "plain text")
    assert run(3, site="s") == {"a.md": ("unchanged", 1), "b.md": ("added", 1)} and count() == 1  # t's files are not missing
    assert {v[0] for v in run(4, size=500).values()} == {"changed"} and count() == 3  # another splitter setting
    assert len({r.chunk_id for r in held.read().collect()}) == held.read().count() == 3


def test_presence_and_trust_from_runs(spark, tmp_path):
    """A page that a sitemap leaves out turns inactive after its site's grace, incomplete runs change nothing, and it comes back; trust is measured from what was observed."""
    a = "https://a.example"
    site = Site("a", a, sitemap_urls=(f"{a}/s.xml",), cache_ttl_hours=0, inactive_grace_cycles=1, trust_lastmod=True, audit_days=1)
    held = BucketedSnapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA, manifest.KEY, 8)
    runs, seen = (Snapshots(spark, f"file://{tmp_path}/{n}", s) for n, s in (("r", T.StructType.fromDDL(pipelines.RUNS)), ("p", T.StructType.fromDDL(presence.PRESENCE))))

    counted = Snapshots(spark, f"file://{tmp_path}/c", T.StructType.fromDDL(pipelines.METRICS))

    def run(day, status, *locs):
        responses = spark.createDataFrame([(f"{a}/robots.txt", 404, "", False, None), (f"{a}/s.xml", status, urlset(*locs), False, None)], DDL)
        out = pipelines.discover_sites(spark, Registry([site]), held, runs, responses, F.lit(NOW + timedelta(days=day)), presence=seen, metrics=counted, run_id=f"r{day}")
        states = {r.canonical_url[-1]: r.state for r in presence.states(seen.read(), Registry([site]).table(spark)).collect()}
        return states, {r.metric: r.n for r in out.collect()}.get("inactive_candidate", 0)

    assert run(0, 200, f"{a}/1", f"{a}/2") == ({"1": "present", "2": "present"}, 0)
    assert run(1, 500) == ({"1": "present", "2": "present"}, 0)
    assert run(2, 200, f"{a}/1") == ({"1": "present", "2": "inactive_candidate"}, 1)
    assert run(3, 200, f"{a}/1", f"{a}/2") == ({"1": "present", "2": "back"}, 0)
    assert held.read().count() == 2
    rows = {(r.run_id, r.metric): (r.n, r.state) for r in counted.read().collect()}
    assert rows["r0", "discovered"] == (2, "complete") and rows["r1", "discovered"] == (0, "incomplete") and rows["r2", "inactive_candidate"] == (1, "complete")

    log, results = (Snapshots(spark, f"file://{tmp_path}/{n}", T.StructType.fromDDL(ddl)) for n, ddl in (("log", trust.OBSERVATIONS), ("results", trust.RESULTS)))
    pages = [f"{a}/{i}" for i in range(12)]
    for day in range(3):
        rows = [("a", p, p, NOW + timedelta(days=day), f"h{day if i != 11 else min(day, 1)}", "eligible") for i, p in enumerate(pages)]
        held.update(lambda _, rows=rows: manifest.conform(spark.createDataFrame(rows, "site_name string, canonical_url string, source_url string, sitemap_lastmod timestamp, content_hash string, scope_status string")))
        for _ in range(2):  # once more at the same time
            pipelines.observe(held, log, F.lit(NOW + timedelta(days=day)))
    assert log.read().count() == 36
    measured = [pipelines.measure_trust(log, results, site, F.lit(NOW), F.lit(NOW + timedelta(days=d)), F.lit(NOW + timedelta(days=9))).first() for d in (1, 2, 3)]
    assert [(r.sampled, r.lastmod_changed, r.with_content, r.with_lastmod, r.long_enough, r.trusted) for r in measured] == [(12, 0, 0, 0, True, False), (12, 12, 12, 12, True, True), (12, 12, 11, 12, True, True)]
    assert trust.earned(Registry([site]).table(spark), results.read()).first().trust_lastmod
    assert not trust.earned(Registry([site]).table(spark), results.read().limit(0)).first().trust_lastmod
    assert {r.canonical_url for r in trust.sample(log.read(), 5).collect()} < set(pages) and trust.sample(log.read(), 5).count() == 5
