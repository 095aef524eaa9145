from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import GapCrawl, Site
from siltstone.operators import manifest, rag
from siltstone.plans import pipelines
from siltstone.sources import markdown
from siltstone.sources.snapshots import Snapshots

NOW = datetime(2026, 8, 5)
RUNS = T.StructType([T.StructField("site_name", T.StringType()), T.StructField("completed_at", T.TimestampType()), T.StructField("complete", T.BooleanType()), T.StructField("config_fingerprint", T.StringType())])
A = "https://a.example"


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


RESPONSES = [
    (f"{A}/robots.txt", 200, "User-agent: *", False),
    (f"{A}/s.xml", 200, index(f"{A}/c1.xml", f"{A}/c2.xml"), False),
    (f"{A}/c1.xml", 200, urlset(f"{A}/p1?utm_source=x", f"{A}/p2", "https://evil.example/p"), False),
    (f"{A}/c2.xml", 200, index(f"{A}/c3.xml", f"{A}/s.xml"), False),
    (f"{A}/c3.xml", 200, urlset(f"{A}/p1", f"{A}/search?q=1"), False),
    ("http://127.0.0.1/x.xml", 200, urlset("http://127.0.0.1/secret"), False),
]
DDL = "url string, status int, body string, error boolean"
SITE = Site("a", A, sitemap_urls=(f"{A}/s.xml",), allowed_domains=("a.example",), exclude_url_patterns=("*/search*",))


def stores(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/m", manifest.SCHEMA), Snapshots(spark, f"file://{tmp_path}/r", RUNS)


def counts(df):
    return {r.metric: r.n for r in df.collect()}


def test_discover_render_ingest(spark, tmp_path):
    held, runs = stores(spark, tmp_path)
    responses = spark.createDataFrame(RESPONSES, DDL)
    walked = pipelines.walk_sitemaps(responses, SITE)
    assert walked.complete and walked.child_sitemaps == 3
    first = pipelines.discover(spark, SITE, held, runs, responses, F.lit(NOW))
    assert counts(first) == {"discovered": 5, "eligible": 3, "excluded:excluded_by_pattern": 1, "excluded:domain_not_allowed": 1}
    assert first.first().complete and not first.first().cached
    again = pipelines.discover(spark, SITE, held, runs, responses, F.lit(NOW + timedelta(hours=23)))
    assert again.first().cached and counts(again)["discovered"] == 4
    late = pipelines.discover(spark, SITE, held, runs, responses, F.lit(NOW + timedelta(hours=24)))
    assert not late.first().cached

    due = pipelines.plan_render(held.read(), SITE, F.lit(NOW))
    assert [r.canonical_url for r in due.orderBy("rank").collect()] == [f"{A}/p1", f"{A}/p2"]
    pages = spark.createDataFrame([(f"{A}/p1", "<title>One</title><article><p>" + "useful words here " * 20 + "</p></article>"), (f"{A}/p2", "<p>thin</p>")], "url string, html string")
    rows = pipelines.apply_render(held, due, pipelines.rendered_pages(pages), SITE, F.lit(NOW))
    assert {r.canonical_url: r.outcome for r in rows.collect()} == {f"{A}/p1": "saved", f"{A}/p2": "failure"}
    cov = manifest.coverage(held.read()).first()
    assert (cov.eligible, cov.current, cov.coverage, cov.below_target) == (2, 1, 50.0, True)
    assert [r.canonical_url for r in pipelines.plan_render(held.read(), SITE, F.lit(NOW)).collect()] == []


def test_metrics_by_run(spark, tmp_path):
    held, runs = stores(spark, tmp_path)
    metrics = Snapshots(spark, f"file://{tmp_path}/x", T.StructType.fromDDL(pipelines.METRICS))
    found = pipelines.discover(spark, SITE, held, runs, spark.createDataFrame(RESPONSES, DDL), F.lit(NOW))
    seen = pipelines.record_metrics(metrics, held, "r1", SITE, "discovery", "complete", F.lit(NOW), found)
    assert seen == held.versions()[-1]
    due = pipelines.plan_render(held.read(), SITE, F.lit(NOW))
    pages = spark.createDataFrame([(f"{A}/p1", "<article><p>" + "useful words here " * 20 + "</p></article>")], "url string, html string")
    pipelines.apply_render(held, due, pipelines.rendered_pages(pages, SITE), SITE, F.lit(NOW))
    assert pipelines.record_metrics(metrics, held, "r2", SITE, "render", "complete", F.lit(NOW)) == seen + 1
    for _ in range(2):  # once more under the same id
        pipelines.record_metrics(metrics, held, "r3", SITE, "discovery", "incomplete", F.lit(NOW))
    rows = metrics.read().collect()
    assert len(rows) == len({(r.run_id, r.metric) for r in rows})
    by = {(r.run_id, r.metric): (r.n, r.version) for r in rows}
    assert by["r1", "discovered"] == (5, seen) and by["r1", "current"] == (0, seen) and by["r2", "discovered"] == (4, seen + 1) and by["r2", "current"] == (1, seen + 1)
    assert {r.run_id: (r.coverage_percent, r.short) for r in pipelines.run_coverage(metrics.read(), SITE).collect()} == {"r1": (0.0, True), "r2": (50.0, True)}
    assert pipelines.health(spark.createDataFrame([("m:1",)], "name string"), "m:1").first().model_available


def test_incomplete_runs_do_not_count(spark, tmp_path):
    held, runs = stores(spark, tmp_path)
    broken = spark.createDataFrame([r if not r[0].endswith("c3.xml") else (r[0], 200, "<urlset>", False) for r in RESPONSES], DDL)
    assert not pipelines.discover(spark, SITE, held, runs, broken, F.lit(NOW)).first().complete
    assert not runs.read().first().complete
    for down in ([(f"{A}/robots.txt", 503, "", False)], []):
        stopped = pipelines.discover(spark, SITE, held, runs, spark.createDataFrame(down, DDL), F.lit(NOW))
        assert counts(stopped) == {"discovered": 0, "eligible": 0} and not stopped.first().complete
    foreign = spark.createDataFrame([r if not r[0].endswith("/s.xml") else (r[0], 200, index(f"{A}/c1.xml", "http://127.0.0.1/x.xml"), False) for r in RESPONSES], DDL)
    walked = pipelines.walk_sitemaps(foreign, SITE)
    assert not walked.complete and walked.child_sitemaps == 1 and "secret" not in str(walked.urls.collect())
    whole = spark.createDataFrame(RESPONSES, DDL)
    capped = pipelines.walk_sitemaps(whole, SITE, max_children=1)
    assert not capped.complete and capped.child_sitemaps == 1
    assert pipelines.walk_sitemaps(whole, SITE, max_children=3).complete
    assert not pipelines.walk_sitemaps(whole, SITE, sitemap_urls=(f"{A}/s.xml", "https://evil.example/s.xml")).complete
    assert not pipelines.walk_sitemaps(whole, SITE, sitemap_urls=()).complete
    port = Site("p", A, sitemap_urls=("https://U:p@A.example:443/s.xml",))
    assert not pipelines.walk_sitemaps(whole, port).complete  # its host is allowed, but nothing answers there


def test_robots_give_sitemaps_and_delay(spark, tmp_path):
    held, runs = stores(spark, tmp_path)
    rules = f"User-agent: *\nCrawl-delay: 7\nSitemap: {A}/s.xml"
    responses = spark.createDataFrame([(f"{A}/robots.txt", 200, rules, False)] + [r for r in RESPONSES if not r[0].endswith("robots.txt")], DDL)
    out = pipelines.discover(spark, Site("a", A, allowed_domains=("a.example",)), held, runs, responses, F.lit(NOW))
    assert counts(out)["discovered"] == 5 and (out.first().complete, out.first().min_delay, out.first().max_delay) == (True, 7.0, 7.0)
    assert {r.scope_status for r in held.read().filter("source_url like '%evil%'").collect()} == {"out_of_scope"}


TITLES = ["Residence permit: how to apply", '#1 "quoted" \\ title', "yes", "2026-01-01", "it's {a: [b]}", "ünï \u2028 🎉"]


def test_from_crawl_to_answers(spark, tmp_path):
    """Discover, render, write, move, ingest and answer, with titles that YAML could read as something else."""
    held, runs = stores(spark, tmp_path)
    site = Site("a", A, sitemap_urls=(f"{A}/s.xml",), allowed_domains=("a.example",))
    urls_ = [f"{A}/p{i}" for i in range(len(TITLES))]
    responses = spark.createDataFrame([(f"{A}/robots.txt", 404, "", False), (f"{A}/s.xml", 200, urlset(*urls_), False)], DDL)
    assert pipelines.discover(spark, site, held, runs, responses, F.lit(NOW)).first().complete
    root = f"{tmp_path}/content"
    words = [f"subject{i} " * 30 for i in range(len(TITLES))]

    def render(rows, now):
        ddl = "canonical_url string, success boolean, exception boolean, status_code int, cache_status string, fit_markdown string, raw_markdown string, meta_url string, url string, title string, fallback_success boolean, fallback_fit_markdown string, fallback_raw_markdown string, fallback_meta_url string, fallback_url string, fallback_title string"
        results = spark.createDataFrame([(u, True, False, 200, "miss", m, "", None, final, t, False, None, None, None, None, None) for u, m, final, t in rows], ddl)
        due = pipelines.plan_render(held.read(), site, F.lit(now), force=True)
        return pipelines.apply_render(held, due, results, site, F.lit(now), root)

    render(list(zip(urls_, words, urls_, TITLES, strict=True)), NOW)
    files = markdown.read(spark, root, "a").collect()
    assert sorted(f.metadata["title"] for f in files) == sorted(TITLES) and {f.url for f in files} == set(urls_)
    assert all(set(f.metadata) == {"title", "source_url", "canonical_url", "content_hash", "language", "extractor_version", "crawl_timestamp"} for f in files)
    render([(urls_[0], words[0], f"{A}/moved", TITLES[0])], NOW + timedelta(days=1))
    assert f"{A}/moved" in {f.url for f in markdown.read(spark, root, "a").collect()} and len(list((tmp_path / "content/a/parsed").iterdir())) == len(TITLES)
    (tmp_path / "content/a/parsed/broken.md").write_text("---\na: [\n---\nx")
    assert [r.path.rsplit("/", 1)[-1] for r in markdown.rejected(spark, root).collect()] == ["broken.md"]
    chunks_ = pipelines.ingest(spark, root, site="a").withColumn("id", F.xxhash64("chunk_id"))
    asked = spark.createDataFrame([(3, "subject0", "auto")], "query_id long, message string, preferred string")
    cite = rag.events(rag.answer(asked, chunks_, k=1)).filter("event = 'citation'").first().data
    assert TITLES[0] in cite and f"{A}/moved" in cite


def test_gap_crawl(spark, tmp_path):
    held, runs = stores(spark, tmp_path)
    site = Site("g", A, discovery_source="none", allowed_domains=("a.example",), gap_crawl=GapCrawl(True, (f"{A}/",), 2, 3))
    links = spark.createDataFrame([(f"{A}/", f"{A}/1"), (f"{A}/", "https://b.example/"), (f"{A}/1", f"{A}/2"), (f"{A}/2", f"{A}/3"), (f"{A}/1", f"{A}/")], "src string, dst string")
    out = pipelines.discover(spark, site, held, runs, None, F.lit(NOW), links)
    assert counts(out) == {"discovered": 3, "eligible": 3} and out.first().complete
    pages = spark.createDataFrame([(f"{A}/1", False, None), (f"{A}/2", True, "text/html")], "url string, success boolean, content_type string")
    out = pipelines.discover(spark, site, held, runs, None, F.lit(NOW), links, pages)
    assert counts(out) == {"discovered": 1, "eligible": 1} and not out.first().complete
    pdf = pages.withColumn("content_type", F.lit("application/pdf; x=1")).withColumn("success", F.lit(True))
    html = Site("g", A, discovery_source="none", allowed_domains=("a.example",), allowed_content_types=("text/html",), gap_crawl=site.gap_crawl)
    assert counts(pipelines.discover(spark, html, held, runs, None, F.lit(NOW), links, pdf)) == {"discovered": 1, "eligible": 1}


def test_ingest_and_requests(spark, tmp_path):
    (tmp_path / "content/s/parsed").mkdir(parents=True)
    (tmp_path / "content/s/parsed/a.md").write_text("---\ntitle: T\nsource_url: https://a.example/a\n---\n" + "# H\n\n" + "word " * 600)
    (tmp_path / "content/s/parsed/empty.md").write_text("---\ntitle: E\n---\n \n")
    rows = pipelines.ingest(spark, str(tmp_path / "content"), site="s").orderBy("chunk_index").collect()
    assert len(rows) == rows[0].total_chunks >= 3 and all(len(r.page_content) <= 1000 and len(r.embedding) == 384 for r in rows)
    assert (rows[0].source_id, rows[0].file_name, rows[0].citation_url, rows[0].title) == ("a", "a.md", "https://a.example/a", "T")
    assert pipelines.ingest(spark, str(tmp_path / "content"), site="other").count() == 0
    asked = spark.createDataFrame([("hi", "auto", None), ("", "auto", None), ("hi", "x", None), ("hi", "work", [("system", "s")])], "message string, agent_id string, history array<struct<role:string,content:string>>").coalesce(1)
    assert [r.rejected for r in pipelines.valid_requests(asked, ["work"]).collect()] == [None, "empty_message", "unknown_guide", "bad_role"]
