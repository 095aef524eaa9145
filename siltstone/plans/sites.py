"""Queries over many sites at once: scope, discovery, due records, robots rules, host schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import GapCrawl, Registry, Site
from siltstone.functions import urls
from siltstone.operators import discovery, hosts, manifest, presence, robots, trust
from siltstone.operators import sites as site_settings
from siltstone.plans import lifecycle, pipelines
from siltstone.plans.catalog import query, table
from siltstone.plans.discovery import _PARTS, _VARIANTS_SQL, DOMAINS, variants
from siltstone.sources.snapshots import Snapshots
from siltstone.staging import shared_root, staged

NOW = "2026-08-05 00:00:00"

# Four sites whose settings differ; their pages are those whose id is the site's number modulo four.
SCOPES = Registry(
    [
        Site("site0", "https://m0.example", exclude_url_patterns=("*/de/*",)),
        Site("site1", "https://m1.example", allowed_domains=(DOMAINS[0], DOMAINS[1].upper()), exclude_url_patterns=("*.html", "*[?]*utm_*")),
        Site("site2", "https://m2.example"),
        Site("site3", "https://m3.example", allowed_domains=DOMAINS, exclude_url_patterns=("/[!a-e]*",)),
    ]
)
_TARGET = "(path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END)"
_SITE_SCOPE = f"""CASE page_id % 4 WHEN 0 THEN CASE WHEN regexp_matches({_TARGET}, '(?s)^.*/de/.*$') THEN 'excluded_by_pattern' END
 WHEN 1 THEN CASE WHEN host NOT IN ('{DOMAINS[0]}', '{DOMAINS[1]}') THEN 'domain_not_allowed' WHEN regexp_matches({_TARGET}, '(?s)^.*\\.html$') OR regexp_matches({_TARGET}, '(?s)^.*[?].*utm_.*$') THEN 'excluded_by_pattern' END
 WHEN 3 THEN CASE WHEN host NOT IN ('{"','".join(DOMAINS)}') THEN 'domain_not_allowed' WHEN regexp_matches({_TARGET}, '(?s)^/[^a-e].*$') THEN 'excluded_by_pattern' END END"""


def _site(name: str = "page_id"):
    return F.concat(F.lit("site"), (F.col(name) % 4).cast("string"))


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + f", r AS (SELECT page_id, variant, {_SITE_SCOPE} AS scope_reason FROM canonical) SELECT 'site' || (page_id % 4) AS site_name, page_id, variant, scope_reason, CASE coalesce(scope_reason, '') WHEN '' THEN 'eligible' WHEN 'domain_not_allowed' THEN 'out_of_scope' ELSE 'excluded' END AS scope_status FROM r")
def sites_scope(spark, sf_dir):
    """URLs judged by the settings of their own site, which are rows and not part of the plan."""
    rows = variants(spark, sf_dir).withColumn("site_name", _site())
    return site_settings.with_scope(rows, SCOPES.table(spark), "u").select("site_name", "page_id", "variant", "scope_reason", "scope_status")


# Sitemaps of the pages: a child for each forty pages of a site, the index lists the children from the last one to the
# first, and every third page is also in the child after its own.  site1 has a child that fails, site2's robots rules
# can't be reached, site3 names its sitemap in its robots rules alone, and asks for a delay.
SITES = Registry(
    [
        Site("site0", "https://m0.example", sitemap_urls=("https://m0.example/index.xml",), exclude_url_patterns=("*/de/*",)),
        Site("site1", "https://m1.example", sitemap_urls=("https://m1.example/index.xml",)),
        Site("site2", "https://m2.example", sitemap_urls=("https://m2.example/index.xml",)),
        Site("site3", "https://m3.example", allowed_domains=(*DOMAINS, "m3.example"), min_delay=2.0),
    ]
)


def site_responses(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 4).alias("s"), F.floor(F.col("page_id") / 160).alias("c"))
    home = F.concat(F.lit("https://m"), F.col("s").cast("string"), F.lit(".example"))

    def entry(day):
        return F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd"), F.lit("</lastmod></url>"))

    rows = p.select("s", "c", "page_id", entry(F.col("page_id") % 300).alias("e"))
    rows = rows.unionByName(p.filter("page_id % 3 = 0").select("s", (F.col("c") + 1).alias("c"), "page_id", entry(F.lit(400)).alias("e")))

    def joined(order, what):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), what.alias("w")))), lambda x: x["w"]), "")

    child = F.concat(home, F.lit("/c"), F.col("c").cast("string"), F.lit(".xml"))
    maps = rows.groupBy("s", "c").agg(F.concat(F.lit("<urlset>"), joined(F.col("page_id"), F.col("e")), F.lit("</urlset>")).alias("body"))
    status = F.when((F.col("s") == 1) & (F.col("c") == 0), 500).otherwise(200)
    sheets = maps.select(child.alias("url"), status.alias("status"), "body")
    link = F.concat(F.lit("<sitemap><loc>"), child, F.lit("</loc></sitemap>"))
    indexes = maps.select("s", "c", link.alias("link")).groupBy("s").agg(F.concat(F.lit("<sitemapindex>"), joined(-F.col("c"), F.col("link")), F.lit("</sitemapindex>")).alias("body")).select(F.concat(home, F.lit("/index.xml")).alias("url"), F.lit(200).alias("status"), "body")
    rules = [("https://m0.example/robots.txt", 404, ""), ("https://m1.example/robots.txt", 200, "User-agent: *\nDisallow:"), ("https://m2.example/robots.txt", 503, ""), ("https://m3.example/robots.txt", 200, "User-agent: *\nCrawl-delay: 7\nSitemap: https://m3.example/index.xml")]
    return sheets.unionByName(indexes).unionByName(spark.createDataFrame(rules, "url string, status int, body string")).withColumn("error", F.lit(False))


def _stores(spark) -> tuple[Snapshots, Snapshots]:
    root = f"{shared_root(spark).rstrip('/')}/siltstone-run-{uuid.uuid4().hex}"
    return Snapshots(spark, f"{root}/manifest", manifest.SCHEMA), Snapshots(spark, f"{root}/runs", T.StructType.fromDDL(pipelines.RUNS))


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    held, runs = _stores(spark)
    summary = pipelines.discover_sites(spark, SITES, held, runs, site_responses(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return held.read(), summary


# What each site's run finds: a failing child leaves out its own occurrences only.
_FOUND_SQL = (
    "WITH src AS (SELECT page_id, 0 AS variant, url AS u FROM pages),"
    + _PARTS
    + f""", p AS (SELECT page_id, page_id % 4 AS s, page_id // 160 AS c, u, canonical_url, host, {_TARGET} AS target FROM canonical),
o AS (SELECT s, c, page_id, u, canonical_url, host, target, page_id % 300 AS day FROM p UNION ALL SELECT s, c + 1, page_id, u, canonical_url, host, target, 400 FROM p WHERE page_id % 3 = 0),
f AS (SELECT 'site' || s AS site_name, u, canonical_url, day, -c AS rank, page_id, CASE WHEN s = 3 AND host NOT IN ('{"','".join(DOMAINS)}') THEN 'domain_not_allowed' WHEN s = 0 AND regexp_matches(target, '(?s)^.*/de/.*$') THEN 'excluded_by_pattern' END AS reason
 FROM o WHERE s <> 2 AND NOT (s = 1 AND c = 0))
"""
)


@query(_FOUND_SQL + """SELECT site_name, canonical_url, CAST(epoch(TIMESTAMP '2026-01-01' + to_days(CAST(arg_max(day, (rank, page_id)) AS INTEGER))) AS BIGINT) AS lastmod, arg_max(coalesce(reason, ''), (rank, page_id)) AS reason FROM f GROUP BY 1, 2""")
def sites_manifest(spark, sf_dir):
    """The manifest after one discovery run over all sites: a URL's last occurrence in queue order gives its lastmod."""
    m, _ = _run(spark, sf_dir)
    return m.select("site_name", "canonical_url", F.unix_timestamp("sitemap_lastmod").alias("lastmod"), F.coalesce("scope_reason", F.lit("")).alias("reason"))


@query(
    _FOUND_SQL
    + """, n AS (SELECT site_name, 'discovered' AS metric, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT site_name, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'excluded:' || reason END, count(*) FROM f GROUP BY 1, 2),
z AS (SELECT 'site' || i AS site_name, m AS metric FROM range(4) AS t(i), (VALUES ('discovered'), ('eligible')) AS v(m)),
a AS (SELECT site_name, metric, coalesce(n.n, 0) AS n FROM z FULL JOIN n USING (site_name, metric))
SELECT site_name, metric, n, site_name IN ('site0', 'site3') AS complete, CASE site_name WHEN 'site3' THEN 7.0 ELSE 1.0 END AS min_delay, CASE site_name WHEN 'site3' THEN 7.0 ELSE 3.0 END AS max_delay FROM a"""
)
def sites_discover(spark, sf_dir):
    """Counts, completeness and delays of one discovery run over all sites."""
    return _run(spark, sf_dir)[1].select("site_name", "metric", "n", "complete", "min_delay", "max_delay")


# Sites that differ in what makes a record due.
DUE = Registry([Site(f"site{i}", f"https://d{i}.example", trust_lastmod=i != 1, audit_days=8 + 3 * i) for i in range(5)])


@query(
    f"WITH {lifecycle._STATE_SQL}"
    + """, d AS (SELECT *, CAST(substr(site_name, 5) AS INTEGER) AS i FROM mf),
r AS (SELECT *, CASE WHEN retry_after > TIMESTAMP '2024-02-15' THEN NULL WHEN retry_count > 5 AND last_rendered_at IS NULL THEN NULL WHEN last_rendered_at IS NULL THEN 'initial_backfill' WHEN i <> 1 AND sitemap_lastmod > last_rendered_at THEN 'lastmod_changed'
 WHEN extractor_version IS DISTINCT FROM '2' THEN 'extractor_version_stale' WHEN TIMESTAMP '2024-02-15' >= coalesce(last_attempt_at, last_rendered_at) + to_days(8 + 3 * i) THEN 'scheduled_audit' END AS reason FROM d WHERE scope_status = 'eligible'),
k AS (SELECT site_name, canonical_url, reason, row_number() OVER (PARTITION BY site_name ORDER BY canonical_url) AS rank FROM r WHERE reason IS NOT NULL)
SELECT site_name, canonical_url, reason, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 7"""
)
def sites_due(spark, sf_dir):
    """What is due on all sites, by each one's trust in lastmod and audit time, seven records of each."""
    due = pipelines.plan_render(lifecycle.state(spark, sf_dir), DUE, lifecycle.now(), 7)
    return due.select("site_name", "canonical_url", F.col("decision.reason").alias("reason"), F.col("rank").cast("int").alias("rank"))


@query("SELECT page_id, CAST(page_id % 7 AS DOUBLE) AS crawl_delay, split_part(url, '#', 1) AS sitemaps, false AS private_allowed FROM pages")
def robots_parse(spark, sf_dir):
    bodies = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.col("page_id") % 7).cast("string"), F.lit("\nDisallow: /private\nSitemap: "), F.col("url")).alias("body"))
    rules, agent = robots.parse(bodies, ["page_id"]), F.lit("bot")
    return rules.select("page_id", robots.crawl_delay(F.col("stanzas"), agent).alias("crawl_delay"), F.array_join("sitemap_urls", ",").alias("sitemaps"), robots.allows(F.col("stanzas"), agent, F.lit("https://example.org/private/x")).alias("private_allowed"))


_RULES = """Disallow: /early

User-agent: idle

# comment only
USER-AGENT : Alpha # two names, one stanza
User-agent: bot
Crawl-delay: {delay}
Allow: /open
Disallow: /*.pdf
Disallow: /
Sitemap: https://h.example/{page}.xml
   
User-agent: *
Crawl-delay: 9
Crawl-delay: soon
Disallow: /private%2Fdeep
Disallow: /private
Allow: /private/x
Disallow:
Disallow: /later

User-agent: *
Disallow: /never"""
_AGENTS, _PATHS = ("my-bot/1.0", "other", "ALPHABET/2", "idle"), ("/open/a", "/closed", "/private/x", "/later", "/never", "", "/a.pdf", "/early")


@query(
    f"""WITH p AS (SELECT page_id, page_id % 4 IN (0, 2) AS own, ['{"','".join(_PATHS)}'][1 + page_id % 8] AS path FROM pages)
SELECT page_id, CASE WHEN own AND page_id % 3 > 0 THEN CAST(page_id % 3 AS DOUBLE) ELSE 9.0 END AS crawl_delay, 'https://h.example/' || page_id || '.xml' AS sitemaps,
CASE WHEN own THEN path = '/open/a' ELSE path NOT LIKE '/private%' END AS allowed FROM p"""
)
def robots_rules(spark, sf_dir):
    """Several stanzas, names that share one, own delay zero, lines that mean nothing, rules in their order, and wildcards as plain signs."""
    head, tail = _RULES.replace("{delay}", "\x00").replace("{page}", "\x01").split("\x00")
    mid, end = tail.split("\x01")
    body = F.concat(F.lit(head), (F.col("page_id") % 3).cast("string"), F.lit(mid), F.col("page_id").cast("string"), F.lit(end))

    def nth(of, n):
        return F.element_at(F.array(*map(F.lit, of)), (F.col("page_id") % n + 1).cast("int"))

    pages = table(spark, sf_dir, "pages").select("page_id", body.alias("body"), nth(_AGENTS, 4).alias("agent"), F.concat(F.lit("https://h.example"), nth(_PATHS, 8)).alias("target"))
    j = robots.parse(pages, ["page_id"]).join(pages.select("page_id", "agent", "target"), "page_id")
    return j.select("page_id", robots.crawl_delay(F.col("stanzas"), F.col("agent")).alias("crawl_delay"), F.array_join("sitemap_urls", ",").alias("sitemaps"), robots.allows(F.col("stanzas"), F.col("agent"), F.col("target")).alias("allowed"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, epoch_us(ts) AS a, CAST(250000 * (2 + event_id % 6) AS BIGINT) AS d,
 CASE WHEN event_id % 11 = 0 THEN 1000000::BIGINT * CASE event_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 3 WHEN 2 THEN 3600 ELSE 90 END ELSE 0 END AS s, event_id % 11 = 0 AND event_id % 4 = 2 AS over FROM events),
r AS (SELECT event_id, user_id, k, a AS starts, a + greatest(d, s) AS free, false AS incomplete, over FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.k, greatest(e.a, r.free), greatest(e.a, r.free) + greatest(e.d, e.s), r.incomplete OR r.over, e.over FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, CAST(starts AS BIGINT) AS starts_at, incomplete FROM r"""
)
def host_schedule(spark, sf_dir):
    """When each request of a host starts: delays that differ, suspensions by number, without a value, and beyond the cap."""
    i = F.col("event_id")
    header = F.when(i % 4 == 0, "30").when(i % 4 == 2, "4000").when(i % 4 == 3, "90.0")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("host"), i.alias("ordinal"), F.col("ts").cast("timestamp").alias("arrived_at"), ((2 + i % 6) * 0.25).alias("delay"), F.when(i % 11 == 0, F.when(i % 2 == 0, 429).otherwise(503)).otherwise(200).alias("status"), header.alias("retry_after"))
    return hosts.schedule_requests(e, F.lit(3.0)).select("event_id", F.unix_micros("starts_at").alias("starts_at"), "incomplete")


_GAP_SQL = """WITH RECURSIVE p AS (SELECT page_id, url, regexp_extract(url, '\\.example\\.([a-z]+)', 1) AS e FROM pages), n AS (SELECT count(*) AS n FROM pages),
l AS (SELECT a.url AS src, b.url AS dst, b.e, s.pos FROM p a, n, (VALUES (0, 7), (1, 1), (2, 3)) AS s(pos, step) JOIN p b ON b.page_id = (a.page_id + s.step) % n.n),
g AS (SELECT * FROM (VALUES ('com', 8, 40), ('net', 3, 1000), ('org', 8, 10)) AS t(e, depth, pages)),
r(e, node, depth, path) AS (SELECT g.e, p.url, 0, [row_number() OVER (PARTITION BY g.e ORDER BY p.page_id DESC) * 1] FROM g JOIN p ON p.e = g.e AND p.page_id < 12
 UNION ALL SELECT r.e, l.dst, r.depth + 1, list_append(r.path, l.pos) FROM r JOIN g ON g.e = r.e JOIN l ON l.src = r.node AND l.e = r.e WHERE r.depth < g.depth),
f AS (SELECT e, node, min(depth) AS depth, min([depth] || path) AS path FROM r GROUP BY 1, 2),
k AS (SELECT e, node, depth, row_number() OVER (PARTITION BY e ORDER BY depth, path) AS place FROM f)
SELECT k.e AS site_name, node, CAST(k.depth AS INTEGER) AS depth FROM k JOIN g ON g.e = k.e WHERE place <= g.pages"""


@query(_GAP_SQL)
def gap_crawl_bfs(spark, sf_dir):
    """Three gap crawls at once, over links between pages seven, one and three apart, each within its domains, depth and page budget."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"\.example\.([a-z]+)", 1).alias("site_name"))
    n = p.count()
    steps = p.select(F.col("url").alias("src"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), ((F.col("page_id") + s) % n).alias("page_id")) for i, s in enumerate((7, 1, 3))])).alias("to"))
    links = steps.select("src", "to.*").join(p.select("page_id", F.col("url").alias("dst")), "page_id").select("src", "dst", "pos")
    own = p.groupBy("site_name").agg(F.collect_set(urls.host(F.col("url"))).alias("allowed_domains"), F.transform(F.sort_array(F.collect_list(F.when(F.col("page_id") < 12, F.struct("page_id", "url"))), asc=False), lambda x: x["url"]).alias("gap_seeds"))
    bounds = Registry([Site(e, f"https://{e}.example", gap_crawl=GapCrawl(True, (), depth, pages)) for e, depth, pages in (("com", 8, 40), ("net", 3, 1000), ("org", 8, 10))]).table(spark)
    return discovery.gap_crawl(links, own.join(bounds.drop("allowed_domains", "gap_seeds"), "site_name")).select("site_name", "node", "depth")


# Observations of pages (users) of five sites over two windows: lastmod goes up with every third event, content with the
# same events on site0 and site3, with others too on site1, with fewer on site2, and in part on site4.
WATCHED = Registry([Site(f"site{i}", f"https://w{i}.example", trust_lastmod=True, audit_days=a) for i, a in enumerate((7, 7, 7, 30, 7))])
_SEEN_SQL = """
ev AS (SELECT event_id, user_id, user_id % 5 AS s, ts, event_id % 3 = 0 AS m, CASE user_id % 5 WHEN 1 THEN event_id % 3 = 0 OR event_id % 7 = 0 WHEN 2 THEN event_id % 6 = 0 WHEN 4 THEN event_id % 3 = 0 AND event_id % 61 <> 0 ELSE event_id % 3 = 0 END AS c FROM events),
lg AS (SELECT 'site' || s AS site_name, 'https://example.org/' || user_id AS url, ts, event_id, sum(m::INT) OVER w AS lm, sum(c::INT) OVER w AS ch FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sm AS (SELECT site_name, url FROM (SELECT site_name, url, row_number() OVER (PARTITION BY site_name ORDER BY sha256(site_name || ' ' || url)) AS r FROM (SELECT DISTINCT site_name, url FROM lg)) WHERE r <= 50),
pr AS (SELECT site_name, url, ts, lm <> lag(lm) OVER w AS m, ch <> lag(ch) OVER w AS c FROM lg JOIN sm USING (site_name, url) WINDOW w AS (PARTITION BY site_name, url ORDER BY ts, event_id)),
wn AS (SELECT 'site' || i AS site_name, a, b, CASE i WHEN 3 THEN 30 ELSE 7 END AS days FROM range(5) AS t(i), (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16'), (TIMESTAMP '2024-01-16', TIMESTAMP '2024-02-15')) AS v(a, b)),
pg AS (SELECT wn.site_name, a, b, days, url, bool_or(coalesce(m, false)) AS m, bool_or(coalesce(c, false)) AS c, bool_and(NOT coalesce(m, false) OR coalesce(c, false)) AS f, bool_and(NOT coalesce(c, false) OR coalesce(m, false)) AS k FROM wn JOIN pr ON pr.site_name = wn.site_name AND ts >= a AND ts < b GROUP BY ALL),
ct AS (SELECT wn.site_name, wn.a, wn.b, count(url) AS sampled, count(*) FILTER (m) AS lastmod_changed, count(*) FILTER (m AND f) AS with_content, count(*) FILTER (c) AS content_changed, count(*) FILTER (c AND k) AS with_lastmod, epoch(wn.b) - epoch(wn.a) >= 86400 * (1 + any_value(wn.days)) AS long_enough FROM wn LEFT JOIN pg ON pg.site_name = wn.site_name AND pg.a = wn.a GROUP BY 1, 2, 3),
tr AS (SELECT *, long_enough AND lastmod_changed >= 10 AND 10 * with_content >= 9 * lastmod_changed AND 10 * with_lastmod >= 9 * content_changed AS trusted FROM ct)
"""


def observations(spark, sf_dir) -> DataFrame:
    i, s = F.col("event_id"), F.col("user_id") % 5
    m = i % 3 == 0
    c = F.when(s == 1, m | (i % 7 == 0)).when(s == 2, i % 6 == 0).when(s == 4, m & (i % 61 != 0)).otherwise(m)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("lm", F.count_if(m).over(w)).withColumn("ch", F.count_if(c).over(w))
    return e.select(F.concat(F.lit("site"), s.cast("string")).alias("site_name"), F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")).alias("canonical_url"), F.col("ts").alias("observed_at"), F.timestamp_seconds(F.col("lm") * 86400).alias("lastmod"), F.sha2(F.col("ch").cast("string"), 256).alias("content_hash"))


def trust_results(spark, sf_dir) -> DataFrame:
    days = ("2024-01-01", "2024-01-16", "2024-02-15")
    spans = F.explode(F.array(*[F.struct(F.lit(a).cast("timestamp").alias("starts_at"), F.lit(b).cast("timestamp").alias("ends_at")) for a, b in zip(days, days[1:], strict=False)]))
    windows = WATCHED.table(spark).select("site_name", F.col("cache_ttl_hours").alias("ttl_hours"), "audit_days", spans.alias("w")).select("site_name", "ttl_hours", "audit_days", "w.*")
    return trust.measure(observations(spark, sf_dir), windows, lifecycle.now())


@query(f"WITH {_SEEN_SQL} SELECT site_name, CAST(epoch(a) AS BIGINT) AS starts_at, sampled, lastmod_changed, with_content, content_changed, with_lastmod, long_enough, trusted FROM tr")
def trust_windows(spark, sf_dir):
    """Whether each site's lastmod has earned trust in each of two windows."""
    return trust_results(spark, sf_dir).select("site_name", F.unix_timestamp("starts_at").alias("starts_at"), "sampled", "lastmod_changed", "with_content", "content_changed", "with_lastmod", "long_enough", "trusted")


@query(
    f"WITH {_SEEN_SQL}, {lifecycle._STATE_SQL}"
    + """, tt AS (SELECT site_name, arg_max(trusted, b) AS trusted FROM tr GROUP BY 1),
r AS (SELECT mf.*, CASE WHEN retry_after > TIMESTAMP '2024-02-15' THEN NULL WHEN retry_count > 5 AND last_rendered_at IS NULL THEN NULL WHEN last_rendered_at IS NULL THEN 'initial_backfill' WHEN trusted AND sitemap_lastmod > last_rendered_at THEN 'lastmod_changed'
 WHEN extractor_version IS DISTINCT FROM '2' THEN 'extractor_version_stale' WHEN TIMESTAMP '2024-02-15' >= coalesce(last_attempt_at, last_rendered_at) + to_days(CASE site_name WHEN 'site3' THEN 30 ELSE 7 END) THEN 'scheduled_audit' END AS reason FROM mf JOIN tt USING (site_name) WHERE scope_status = 'eligible')
SELECT site_name, canonical_url, reason FROM r WHERE reason IS NOT NULL"""
)
def due_by_trust(spark, sf_dir):
    """What is due where lastmod counts only on sites whose last measurement bears it out."""
    due = pipelines.plan_render(lifecycle.state(spark, sf_dir), WATCHED, lifecycle.now(), 1 << 30, measured=trust_results(spark, sf_dir))
    return due.select("site_name", "canonical_url", F.col("decision.reason").alias("reason"))


@query(
    """WITH f AS (SELECT page_id, page_id % 3 AS s, [(page_id * 7 + r * 3) % 5 < 3 - page_id % 2 FOR r IN range(4)] AS b FROM pages),
m AS (SELECT page_id, s, CASE WHEN s = 1 THEN (((b[1]::INT << 1) | b[2]::INT | b[3]::INT) << 1) | b[4]::INT ELSE (((((b[1]::INT << 1) | b[2]::INT) << 1) | b[3]::INT) << 1) | b[4]::INT END AS mask, b FROM f WHERE list_bool_or(b))
SELECT 'site' || s AS site_name, page_id, CAST(mask AS BIGINT) AS mask, CASE WHEN mask & 1 = 1 THEN CASE WHEN mask & 2 = 0 AND mask > 1 THEN 'back' ELSE 'present' END WHEN mask & ((1 << (s + 1)::INT) - 1) = 0 THEN 'inactive_candidate' ELSE 'missing' END AS state FROM m"""
)
def presence_states(spark, sf_dir):
    """Pages of three sites over four runs, of which one of site1 isn't complete: present, back, missing or inactive, by each site's grace."""
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("site"), (i % 3).cast("string")).alias("site_name"), i.cast("string").alias("canonical_url"))
    sites = Registry([Site(f"site{s}", f"https://p{s}.example", inactive_grace_cycles=s + 1) for s in range(3)]).table(spark)
    held = spark.createDataFrame([], presence.PRESENCE)
    for r in range(4):
        runs = sites.select("site_name", (~((F.col("site_name") == "site1") & F.lit(r == 2))).alias("complete"))
        found = p.filter((i * 7 + r * 3) % 5 < 3 - i % 2)
        held = staged(presence.updated(held, found, runs, F.lit(f"2026-08-0{r + 1} 00:00:00").cast("timestamp")), "presence")
    states = presence.states(held, sites).select("site_name", "canonical_url", "state")
    return held.join(states, ["site_name", "canonical_url"]).select("site_name", F.col("canonical_url").cast("long").alias("page_id"), "mask", "state")
