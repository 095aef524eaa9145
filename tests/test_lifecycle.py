from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.config import GapCrawl, Registry, Site
from siltstone.functions import schedule
from siltstone.operators import discovery, manifest, render, robots
from siltstone.sources import markdown
from siltstone.sources.snapshots import Snapshots

NOW = datetime(2026, 8, 5)
STATE = "retry_after timestamp, retry_count int, last_rendered_at timestamp, sitemap_lastmod timestamp, extractor_version string, last_attempt_at timestamp"
H, D = timedelta(hours=1), timedelta(days=1)


@pytest.mark.parametrize(
    ("state", "trust", "force", "want"),
    [
        ((NOW + H, 1, None, None, None, None), True, True, "forced"),
        ((NOW + H, 1, None, None, None, None), True, False, None),
        ((None, 6, None, None, None, None), True, False, None),
        ((None, 5, None, None, None, None), True, False, "initial_backfill"),
        ((None, 0, NOW - D, NOW, "2", NOW - D), True, False, "lastmod_changed"),
        ((None, 0, NOW - D, NOW, "2", NOW - D), False, False, None),
        ((None, 0, NOW - D, None, None, NOW - D), True, False, "extractor_version_stale"),
        ((None, 0, NOW - 90 * D, None, "2", None), True, False, "scheduled_audit"),
        ((None, 0, NOW - 100 * D, None, "2", NOW - D), True, False, None),
        ((NOW - H, 1, NOW - D, None, "2", NOW - D), True, False, None),
    ],
)
def test_due(spark, state, trust, force, want):
    df = spark.createDataFrame([state], STATE).withColumn("scope_status", F.lit("eligible"))
    got = render.with_decision(df, F.lit(NOW), F.lit(trust), F.lit(90), force).select("decision.reason").first()[0]
    assert got == want


def test_backoff_and_headers(spark):
    n = spark.createDataFrame([(1,), (2,), (5,), (10,)], "n int").coalesce(1)
    assert [r[0] for r in n.select(schedule.backoff_seconds(F.col("n"))).collect()] == [7200, 14400, 86400, 86400]
    cases = [("30", 30.0, False), (None, 3.0, False), ("not-a-value", 3.0, False), ("3601", 3600.0, True), ("Wed, 05 Aug 2026 00:01:00 GMT", 60.0, False), ("", 3.0, False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string").coalesce(1)
    got = df.select(schedule.suspension(F.col("v"), F.lit(NOW), F.lit(3.0)).alias("s")).select("s.*").collect()
    assert [(r.applied, r.capped) for r in got] == [c[1:] for c in cases]


def test_sitemaps(spark):
    flat = '<urlset xmlns="http://x"><url><loc> https://a.example/1 </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://a.example/2</loc></url><url><lastmod>2026-01-01</lastmod></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://a.example/c.xml</loc></sitemap><url><loc>https://a.example/no</loc></url></sitemapindex>"
    rows = discovery.parse_sitemaps(spark.createDataFrame([(1, flat), (2, index), (3, "<urlset><url>"), (4, None)], "i int, body string").coalesce(1)).collect()
    assert [r.kind for r in rows] == ["urlset", "index", "malformed", "malformed"]
    assert [(e["loc"], e["lastmod"]) for e in rows[0].entries] == [("https://a.example/1", datetime(2026, 1, 1)), ("https://a.example/2", None)]
    assert rows[1].children == ["https://a.example/c.xml"] and rows[1].entries == []


def test_robots(spark):
    body = "User-agent: *\nCrawl-delay: 5\nDisallow: /private\n\nUser-agent: own\nCrawl-delay: 0\nSitemap: https://a.example/s.xml\n"
    df = spark.createDataFrame([(1, body, "own"), (2, body, "other"), (3, "User-agent: *\nCrawl-delay: soon", "own"), (4, None, "own")], "i int, body string, agent string").coalesce(1)
    rules = robots.parse(df, ["i"]).join(df, "i").orderBy("i")
    got = rules.select(robots.crawl_delay(F.col("stanzas"), F.col("agent")).alias("d"), robots.allows(F.col("stanzas"), F.col("agent"), F.lit("https://a.example/private/1")).alias("ok")).collect()
    assert [r.d for r in got] == [5.0, 5.0, None, None]
    assert [r.ok for r in got] == [True, False, True, True]
    status = spark.createDataFrame([(404, False), (503, False), (500, False), (200, False), (None, True)], "s int, e boolean").coalesce(1)
    assert [r[0] for r in status.select(robots.classify_response(F.col("s"), F.col("e"))).collect()] == ["no_rules", "suspended", "unreachable", "ok", "unreachable"]


def test_snapshots_and_older_schema(spark, tmp_path):
    held = Snapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA)
    assert held.read().count() == 0
    row = spark.createDataFrame([("s", "https://a.example/", "eligible")], "site_name string, canonical_url string, scope_status string")
    held.update(lambda m: manifest.upsert(m, manifest.conform(row)))
    held.update(lambda m: manifest.upsert(m, manifest.conform(row)))
    assert held.versions() == [1, 2] and held.read().count() == 1
    assert held.read().first().retry_count == 0
    held.expire(1)
    assert held.versions() == [2]


def test_stream_merges_like_a_batch(spark, tmp_path):
    from siltstone.streaming.manifest import merge_stream

    rows = [("s", f"https://A.example/{i % 3}?utm_source=x", "sitemap", None, NOW + i * H) for i in range(6)]
    ddl = "site_name string, source_url string, source string, lastmod timestamp, seen_at timestamp"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in")
    held = Snapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA)
    merge_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), held, f"{tmp_path}/ck").awaitTermination(120)
    got = held.read().orderBy("canonical_url").collect()
    assert [r.canonical_url for r in got] == [f"https://a.example/{i}" for i in range(3)]
    assert got[0].first_seen_at == NOW and got[0].last_seen_at == NOW + 3 * H


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "one/parsed").mkdir(parents=True)
    (tmp_path / "one/parsed/a.md").write_text("---\ntitle: 'A: b'\nsource_file: crawled/one/a.html\n---\nBody\n")
    (tmp_path / "root.md").write_text("no head\n")
    (tmp_path / "one/bad.md").write_text("---\n: : :\n- x\n---\nBody\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in markdown.read(spark, str(tmp_path)).collect()}
    assert got["a.md"].metadata["title"] == "A: b" and got["a.md"].content == "Body" and got["a.md"].url == "one/a.html"
    assert got["root.md"].content == "no head" and "bad.md" not in got
    assert [r.path.rsplit("/", 1)[1] for r in markdown.read(spark, str(tmp_path), "one").collect()] == ["a.md"]


def test_configuration():
    site = Site("s", "https://a.example/")
    assert site.base_dir == "a.example" and site.fingerprint() == Site("s", "https://a.example").fingerprint()
    assert Registry([site]).descriptions() == {"s": "Configuration for s"}
    assert Registry.from_yaml("sites:\n  s:\n    base_url: https://a.example\n    allowed_domains: [a.example]\n").get("s").allowed_domains == ("a.example",)
    nested = Registry.from_yaml("sites:\n  s:\n    base_url: https://a.example\n    markdown: {ignore_links: true}\n    gap_crawl: {enabled: true, seed_urls: [https://a.example/x]}\n").get("s")
    assert nested.markdown.ignore_links and nested.gap_crawl.seed_urls == ("https://a.example/x",)
    for bad in (lambda: GapCrawl(strategy="dfs"), lambda: Site("s", "nowhere"), lambda: Site("s", "https://a", page_timeout=121), lambda: Site("s", "https://a", min_delay=4.0), lambda: GapCrawl(max_depth=11), lambda: Registry([]), lambda: Registry([site]).get("x"), lambda: Site("s", "https://a", discovery_source="none").require_discovery(), lambda: Registry.from_yaml("")):
        with pytest.raises(ValueError):
            bad()
