"""Queries over URLs: canonical forms, scope, sitemaps, frontiers, manifest merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import schedule, urls
from siltstone.operators import discovery, manifest
from siltstone.plans.catalog import query, table

DOMAINS = ("ththrese.example.com", "m.ththth.example.net", "thther.example.org", "blog.ththan.example.net")
EXCLUDE = ("*/de/*", "*?*utm_*", "*.html")

# DuckDB: the canonical form of a column ``u`` from its parts.
_PARTS = r"""
parts AS (SELECT *, lower(regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 1)) AS sch,
  regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 2) AS auth,
  regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 3) AS path,
  regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 4) AS qry FROM src),
named AS (SELECT *, lower(regexp_replace(regexp_extract(auth, '^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$', 1), '^\[|\]$', '', 'g')) AS host,
  regexp_extract(auth, '^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$', 2) AS port,
  list_transform(list_filter(string_split(qry, '&'), lambda p: p <> ''), lambda p: {'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=?(.*)$', 1), '+', ' '))}) AS pairs FROM parts),
canon AS (SELECT *, list_filter(pairs, lambda p: NOT (lower(p.k) IN ('gclid','fbclid','msclkid','_ga','ref') OR lower(p.k) LIKE 'utm\_%' ESCAPE '\' OR lower(p.k) LIKE 'mc\_%' ESCAPE '\')) AS kept,
  CASE WHEN contains(host, ':') THEN '[' || host || ']' ELSE host END AS shown FROM named),
canonical AS (SELECT *, sch || '://' || shown || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda p: replace(replace(url_encode(p.k), '%20', '+'), '*', '%2A') || '=' || replace(replace(url_encode(p.v), '%20', '+'), '*', '%2A')), '&') END AS canonical_url FROM canon)
"""
_VARIANTS_SQL = """
src AS (SELECT page_id, n AS variant, CASE n WHEN 0 THEN url WHEN 1 THEN split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'utm_source=x&id=1&b=a b~*%C3%A9&c#f'
  WHEN 2 THEN upper(regexp_extract(url, '^[^:]+://[^/]+')) || substr(url, len(regexp_extract(url, '^[^:]+://[^/]+')) + 1)
  ELSE regexp_extract(url, '^[^:]+://') || 'user:pw@' || regexp_extract(url, '^[^:]+://([^/]+)', 1) || CASE WHEN page_id % 2 = 0 THEN ':443' ELSE ':8080' END || substr(url, len(regexp_extract(url, '^[^:]+://[^/]+')) + 1) END AS u
  FROM pages, range(4) AS t(n))
"""
_HOST = r"^[^:]+://[^/]+"


def variants(spark, sf_dir) -> DataFrame:
    """Each page's URL as it is and in three other spellings."""
    u = F.col("url")
    bare = F.substring_index(u, "#", 1)
    head = F.regexp_extract(u, _HOST, 0)
    tail = F.regexp_replace(u, _HOST, "")
    forms = F.array(
        u,
        F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&id=1&b=a b~*%C3%A9&c#f")),
        F.concat(F.upper(head), tail),
        F.concat(F.regexp_extract(u, r"^[^:]+://", 0), F.lit("user:pw@"), F.regexp_extract(u, r"^[^:]+://([^/]+)", 1), F.when(F.col("page_id") % 2 == 0, ":443").otherwise(":8080"), tail),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("variant", "u")).withColumn("variant", F.col("variant").cast("long"))


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + "SELECT page_id, variant, canonical_url FROM canonical")
def url_canonicalize(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "variant", urls.canonicalize(F.col("u")).alias("canonical_url"))


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + r"""SELECT k AS param, count(*) AS n, bool_or(lower(k) IN ('gclid','fbclid','msclkid','_ga','ref') OR lower(k) LIKE 'utm\_%' ESCAPE '\' OR lower(k) LIKE 'mc\_%' ESCAPE '\') AS tracking
FROM (SELECT unnest(pairs).k AS k FROM canonical) GROUP BY k""")
def url_tracking_params(spark, sf_dir):
    pairs = variants(spark, sf_dir).select(F.explode(urls.query_pairs(F.col("u"))).alias("p")).select(F.col("p.key").alias("param"))
    return pairs.groupBy("param").agg(F.count("*").alias("n"), F.bool_or(urls.is_tracking(F.col("param"))).alias("tracking"))


def _scope_case() -> str:
    return (
        "CASE WHEN host NOT IN ('" + "','".join(DOMAINS) + "') THEN 'domain_not_allowed' "
        "WHEN (path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END) GLOB '*/de/*' OR regexp_matches(path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END, '(?s)^.*..*utm_.*$') "
        "OR (path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END) GLOB '*.html' THEN 'excluded_by_pattern' END"
    )


def scoped(spark, sf_dir) -> DataFrame:
    return discovery.with_scope(variants(spark, sf_dir), "u", DOMAINS, EXCLUDE)


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + f"SELECT page_id, variant, CASE coalesce({_scope_case()}, '') WHEN '' THEN 'eligible' WHEN 'domain_not_allowed' THEN 'out_of_scope' ELSE 'excluded' END AS scope_status, {_scope_case()} AS scope_reason FROM canonical")
def scope_evaluate(spark, sf_dir):
    return scoped(spark, sf_dir).select("page_id", "variant", "scope_status", "scope_reason")


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + f", s AS (SELECT {_scope_case()} AS r FROM canonical) SELECT 'discovered' AS metric, count(*) AS n FROM s HAVING count(*) > 0 UNION ALL SELECT CASE WHEN r IS NULL THEN 'eligible' ELSE 'excluded:' || r END, count(*) FROM s GROUP BY 1")
def scope_histogram(spark, sf_dir):
    return discovery.summary(scoped(spark, sf_dir))


@query("WITH " + _VARIANTS_SQL + "," + _PARTS + "SELECT page_id, variant FROM canonical WHERE sch IN ('http','https') AND host IN ('" + "','".join(DOMAINS) + "')")
def sitemap_hosts_allowed(spark, sf_dir):
    return variants(spark, sf_dir).filter(discovery.sitemap_allowed(F.col("u"), DOMAINS)).select("page_id", "variant")


@query(
    "WITH "
    + _VARIANTS_SQL
    + ","
    + _PARTS
    + r""", c AS (SELECT DISTINCT canonical_url AS c FROM canonical),
s AS (SELECT c, trim(regexp_extract(c, '^[^:]+://[^/?]*([^?]*)', 1), '/') AS p, regexp_extract(c, '\?(.*)$', 1) AS q FROM c),
t AS (SELECT c, q, trim(regexp_replace(CASE WHEN p = '' THEN 'index' ELSE p END, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') AS stem, trim(regexp_replace(q, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') AS qs FROM s),
v AS (SELECT c, rtrim(substr(CASE WHEN stem = '' THEN 'index' ELSE stem END || CASE WHEN qs = '' THEN '' ELSE '-' || qs END, 1, 239), '-.') AS f FROM t)
SELECT c AS canonical_url, CASE WHEN f = '' THEN 'document' ELSE f END || '-' || substr(sha256(c), 1, 12) || '.md' AS file_name FROM v"""
)
def artifact_filename(spark, sf_dir):
    c = variants(spark, sf_dir).select(urls.canonicalize(F.col("u")).alias("canonical_url")).distinct()
    return c.withColumn("file_name", urls.artifact_filename(F.col("canonical_url")))


# Two waves of discovery over the variants, from arithmetic on ids.
_WAVES_SQL = (
    "WITH "
    + _VARIANTS_SQL
    + ","
    + _PARTS
    + """, d AS (SELECT 'site' || (page_id % 3) AS site_name, canonical_url, u AS source_url, CASE WHEN variant % 2 = 0 THEN 'sitemap' ELSE 'deep_crawl' END AS source,
 CASE WHEN page_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(page_id + variant AS INTEGER)) END AS lastmod,
 CASE WHEN page_id % 5 = 0 THEN 'excluded_by_pattern' ELSE NULL END AS scope_reason, TIMESTAMP '2026-08-04 00:00:00' + to_days(CAST(variant AS INTEGER)) AS seen_at, page_id * 10 + variant AS ordinal, variant // 2 AS wave FROM canonical),
 w AS (SELECT wave, site_name, canonical_url, arg_max(source_url, ordinal) AS source_url, max(ordinal) AS o, list_sort(list(DISTINCT source)) AS srcs, arg_max(lastmod, ordinal) AS lastmod, min(seen_at) AS f, max(seen_at) AS l, arg_max({'r': scope_reason}, ordinal).r AS scope_reason FROM d GROUP BY ALL),
 a AS (SELECT * FROM w WHERE wave = 0), b AS (SELECT * FROM w WHERE wave = 1),
 m AS (SELECT coalesce(b.site_name, a.site_name) AS site_name, coalesce(b.canonical_url, a.canonical_url) AS canonical_url, coalesce(b.source_url, a.source_url) AS source_url,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.srcs, []), coalesce(b.srcs, [])))), ',') AS sources, coalesce(b.lastmod, a.lastmod) AS lastmod, coalesce(a.f, b.f) AS first_seen, greatest(a.l, b.l) AS last_seen,
  CASE WHEN b.site_name IS NOT NULL THEN b.scope_reason ELSE a.scope_reason END AS scope_reason
  FROM a FULL JOIN b ON a.site_name = b.site_name AND a.canonical_url = b.canonical_url)
"""
)


def waves(spark, sf_dir) -> DataFrame:
    p, v = F.col("page_id"), F.col("variant")
    return variants(spark, sf_dir).select(
        F.concat(F.lit("site"), (p % 3).cast("string")).alias("site_name"),
        urls.canonicalize(F.col("u")).alias("canonical_url"),
        F.col("u").alias("source_url"),
        F.when(v % 2 == 0, "sitemap").otherwise("deep_crawl").alias("source"),
        F.when(p % 4 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00").cast("timestamp")) + (p + v) * 3600)).alias("lastmod"),
        F.when(p % 5 == 0, "excluded_by_pattern").alias("scope_reason"),
        F.when(p % 5 == 0, "excluded").otherwise("eligible").alias("scope_status"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2026-08-04 00:00:00").cast("timestamp")) + v * 86400).alias("seen_at"),
        (p * 10 + v).alias("ordinal"),
        F.floor(v / 2).alias("wave"),
    )


def merged_manifest(spark, sf_dir) -> DataFrame:
    d = waves(spark, sf_dir)
    empty = spark.createDataFrame([], manifest.SCHEMA)
    first = manifest.upsert(empty, manifest.collapse(d.filter("wave = 0")))
    return manifest.upsert(first, manifest.collapse(d.filter("wave = 1")))


def _seconds(name: str):
    return F.unix_timestamp(name)


@query(_WAVES_SQL + "SELECT site_name, canonical_url, source_url, sources, CAST(epoch(lastmod) AS BIGINT) AS lastmod, CAST(epoch(first_seen) AS BIGINT) AS first_seen, CAST(epoch(last_seen) AS BIGINT) AS last_seen, CASE WHEN scope_reason IS NULL THEN 'eligible' ELSE 'excluded' END AS scope_status, scope_reason FROM m")
def manifest_upsert(spark, sf_dir):
    m = merged_manifest(spark, sf_dir)
    return m.select("site_name", "canonical_url", "source_url", F.array_join("discovery_source", ",").alias("sources"), _seconds("sitemap_lastmod").alias("lastmod"), _seconds("first_seen_at").alias("first_seen"), _seconds("last_seen_at").alias("last_seen"), "scope_status", "scope_reason")


@query(_WAVES_SQL + "SELECT site_name, count(*) AS n, count(*) FILTER (scope_reason IS NULL) AS eligible FROM m GROUP BY site_name")
def manifest_count_by_site(spark, sf_dir):
    return merged_manifest(spark, sf_dir).groupBy("site_name").agg(F.count("*").alias("n"), F.count_if(F.col("scope_status") == "eligible").alias("eligible"))


@query(_WAVES_SQL + "SELECT canonical_url, source_url FROM m WHERE site_name = 'site1' AND scope_reason IS NULL")
def manifest_list_by_site(spark, sf_dir):
    return manifest.select_rows(merged_manifest(spark, sf_dir), "site1", "eligible").select("canonical_url", "source_url")


@query(_WAVES_SQL + "SELECT canonical_url, source_url FROM m WHERE site_name = 'site0' AND canonical_url = (SELECT min(canonical_url) FROM m WHERE site_name = 'site0')")
def manifest_get(spark, sf_dir):
    m = merged_manifest(spark, sf_dir)
    least = m.filter("site_name = 'site0'").agg(F.min("canonical_url")).first()[0]
    return manifest.get(m, "site0", least).select("canonical_url", "source_url")


@query(_WAVES_SQL + "SELECT canonical_url FROM m WHERE site_name = 'site2' AND scope_reason IS NULL AND canonical_url > 'https://' ORDER BY canonical_url LIMIT 20")
def manifest_keyset_page(spark, sf_dir):
    return manifest.page(merged_manifest(spark, sf_dir), "site2", "https://", 20).select("canonical_url")


@query(_WAVES_SQL + "SELECT site_name, canonical_url, CASE WHEN length(canonical_url) % 2 = 0 THEN 'saved' ELSE NULL END AS title FROM m")
def manifest_save(spark, sf_dir):
    m = merged_manifest(spark, sf_dir)
    return manifest.save(m, m.filter("length(canonical_url) % 2 = 0").withColumn("title", F.lit("saved"))).select("site_name", "canonical_url", "title")


_REKEY_SQL = (
    _WAVES_SQL
    + """, mv AS (SELECT site_name, canonical_url AS old_url, regexp_replace(canonical_url, '/[0-9]+', '/1') AS new_url, source_url, sources, first_seen, last_seen FROM m WHERE length(canonical_url) % 3 = 0 AND regexp_replace(canonical_url, '/[0-9]+', '/1') <> canonical_url),
 g AS (SELECT site_name, new_url AS canonical_url, arg_max(source_url, old_url) AS source_url, list(sources) AS s, min(first_seen) AS f, max(last_seen) AS l FROM mv GROUP BY 1, 2),
 j AS (SELECT g.site_name, g.canonical_url, g.source_url, CASE WHEN m.sources IS NULL THEN g.s ELSE list_append(g.s, m.sources) END AS s, least(g.f, m.first_seen) AS f, greatest(g.l, m.last_seen) AS l FROM g LEFT JOIN m USING (site_name, canonical_url))
"""
)


@query(
    _REKEY_SQL
    + """SELECT site_name, canonical_url, source_url, array_to_string(list_sort(list_distinct(string_split(array_to_string(s, ','), ','))), ',') AS sources, CAST(epoch(f) AS BIGINT) AS first_seen, CAST(epoch(l) AS BIGINT) AS last_seen FROM j
 UNION ALL SELECT site_name, canonical_url, source_url, sources, CAST(epoch(first_seen) AS BIGINT), CAST(epoch(last_seen) AS BIGINT) FROM m WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.site_name = m.site_name AND mv.old_url = m.canonical_url) AND NOT EXISTS (SELECT 1 FROM j WHERE j.site_name = m.site_name AND j.canonical_url = m.canonical_url)"""
)
def manifest_rekey(spark, sf_dir):
    m = merged_manifest(spark, sf_dir)
    moves = m.withColumn("old_url", F.col("canonical_url")).withColumn("canonical_url", F.regexp_replace("canonical_url", "^(.*?)/[0-9]+", "$1/1")).filter("length(old_url) % 3 = 0 and canonical_url <> old_url")
    out = manifest.rekey(m, moves)
    return out.select("site_name", "canonical_url", "source_url", F.array_join("discovery_source", ",").alias("sources"), _seconds("first_seen_at").alias("first_seen"), _seconds("last_seen_at").alias("last_seen"))


_RUNS_SQL = """
WITH runs AS (SELECT 'site' || (user_id % 40) AS site_name, ts AS completed_at, event_id % 7 <> 0 AS complete, 'v1:' || (user_id % 3) AS fp FROM events),
last AS (SELECT site_name, max(completed_at) AS completed_at, arg_max(complete, completed_at) AS complete, arg_max(fp, completed_at) AS fp FROM runs GROUP BY site_name)
SELECT site_name, complete AND fp = 'v1:' || (CAST(substr(site_name, 5) AS BIGINT) % 3) AND (CAST(substr(site_name, 5) AS BIGINT) % 4) * 8 > 0
 AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(completed_at) < (CAST(substr(site_name, 5) AS BIGINT) % 4) * 8 * 3600000000 AS cached FROM last
"""


@query(_RUNS_SQL)
def discovery_cached_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.concat(F.lit("site"), (F.col("user_id") % 40).cast("string")).alias("site_name"), F.col("ts").cast("timestamp").alias("completed_at"), (F.col("event_id") % 7 != 0).alias("complete"), F.concat(F.lit("v1:"), (F.col("user_id") % 3).cast("string")).alias("config_fingerprint"))
    n = F.substring("site_name", 5, 10).cast("long")
    sites = runs.select("site_name").distinct().select("site_name", F.concat(F.lit("v1:"), (n % 3).cast("string")).alias("fingerprint"), ((n % 4) * 8).cast("double").alias("ttl_hours"))
    return discovery.cached_runs(runs, sites, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("site_name", "cached")


@query("""SELECT page_id, url AS loc, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN CAST(epoch(TIMESTAMP '2026-01-01' + to_days(CAST(page_id % 300 AS INTEGER))) AS BIGINT) ELSE NULL END AS lastmod FROM pages WHERE page_id % 10 < 8""")
def sitemap_parse(spark, sf_dir):
    """Sitemaps written from the pages' URLs: two in ten are indexes, whose own URLs don't count, or malformed."""
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc> "), esc, F.lit(" </loc>"), F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))).otherwise("<lastmod>soon</lastmod>"), F.lit("</url><url><lastmod>2026-01-01</lastmod></url>"))
    body = (
        F.when(F.col("page_id") % 10 == 8, F.concat(F.lit("<sitemapindex><sitemap><loc>"), esc, F.lit("</loc></sitemap>"), entry, F.lit("</sitemapindex>")))
        .when(F.col("page_id") % 10 == 9, F.concat(F.lit("<urlset>"), entry))
        .otherwise(F.concat(F.lit('<x:urlset xmlns:x="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.regexp_replace(F.regexp_replace(entry, "<(?!/)", "<x:"), "</", "</x:"), F.lit("</x:urlset>")))
    )
    bodies = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return discovery.parse_sitemaps(bodies).select("page_id", F.explode("entries").alias("e")).select("page_id", F.col("e.loc").alias("loc"), F.unix_timestamp("e.lastmod").alias("lastmod"))


_LINKS_SQL = "links AS (SELECT page_id AS src, page_id * 2 + 1 AS dst FROM pages UNION ALL SELECT page_id, page_id * 3 + 2 FROM pages)"


def links(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"))
    return p.select("src", (F.col("src") * 2 + 1).alias("dst")).unionByName(p.select("src", (F.col("src") * 3 + 2).alias("dst")))


@query(f"""WITH RECURSIVE {_LINKS_SQL}, r(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT links.dst, r.depth + 1 FROM r JOIN links ON links.src = r.node WHERE r.depth < 6) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def sitemap_bfs(spark, sf_dir):
    return discovery.walk(links(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 6)


@query("""WITH p AS (SELECT url, page_id // 40 AS c, page_id % 300 AS day, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 1 END AS n FROM pages),
o AS (SELECT url, c, n, day, 1 AS own FROM p UNION ALL SELECT url, c + 1, 1, 400, 0 FROM p WHERE c % 2 = 0), g AS (SELECT * FROM o WHERE c % 5 <> 3),
u AS (SELECT url, arg_max(day, -c) AS day FROM g GROUP BY url), w AS (SELECT count(DISTINCT c) AS children, CAST(sum(n) AS BIGINT) AS discovered, count(DISTINCT url) AS urls FROM g),
d AS (SELECT CAST(sum(day) AS BIGINT) AS days FROM u), x AS (SELECT * FROM g WHERE c = (SELECT max(c) FROM g))
SELECT run, run = 'whole' AS complete, children, discovered, urls, days FROM w, d, (VALUES ('whole'), ('broken'), ('foreign')) AS r(run)
UNION ALL SELECT 'capped', false, 1, CAST(sum(n) AS BIGINT), count(DISTINCT url), (SELECT CAST(sum(day) AS BIGINT) FROM (SELECT url, any_value(day) AS day FROM x GROUP BY url)) FROM x
UNION ALL SELECT 'none', false, 0, 0, 0, 0""")
def sitemap_run(spark, sf_dir):
    """Whole walks over sitemaps of 40 pages each, listed from the last to the first: as they should be, with a child that fails, with one on another host, cut by the cap, and without any sitemap.

    Half of the pages are in two children; ``days`` sums up the lastmods, which the child that is read last gives.  The
    five runs are five sites of one walk, but for the cap, which is a setting of a walk.
    """
    from siltstone.config import Registry, Site
    from siltstone.plans import pipelines

    home = "https://maps.example"
    day = F.col("page_id") % 300
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.floor(F.col("page_id") / 40).alias("c"))

    def entry(days):
        return F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd"), F.lit("</lastmod></url>"))

    loc = entry(day)
    occurs = p.select("c", "page_id", F.when(F.col("page_id") % 4 == 0, F.concat(loc, loc)).otherwise(loc).alias("e"))
    occurs = occurs.unionByName(p.filter("c % 2 = 0").select((F.col("c") + 1).alias("c"), "page_id", entry(F.lit(400)).alias("e")))

    def joined(order, what):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), what.alias("w")))), lambda x: x["w"]), "")

    child = F.concat(F.lit(home + "/c"), F.col("c").cast("string"), F.lit(".xml"))
    maps = occurs.groupBy("c").agg(F.concat(F.lit("<urlset>"), joined(F.col("page_id"), F.col("e")), F.lit("</urlset>")).alias("body")).select("c", child.alias("child"), (F.col("c") % 5 == 3).alias("bad"), "body")
    sheets = maps.select(F.col("child").alias("url"), F.when(F.col("bad"), 500).otherwise(200).alias("status"), "body", F.lit(False).alias("error"))

    def index(name: str, rows: DataFrame, more: str = "") -> DataFrame:
        link = F.concat(F.lit("<sitemap><loc>"), "child", F.lit("</loc></sitemap>"))
        body = F.concat(F.lit("<sitemapindex>"), joined(-F.col("c"), F.concat(link, link)), F.lit(more + "</sitemapindex>"))
        return rows.groupBy().agg(body.alias("body")).select(F.lit(f"{home}/{name}.xml").alias("url"), F.lit(200).alias("status"), "body", F.lit(False).alias("error"))

    good = maps.filter("not bad")
    responses = sheets.unionByName(index("whole", good)).unionByName(index("broken", maps, f"<sitemap><loc>{home}/missing.xml</loc></sitemap>")).unionByName(index("foreign", good, "<sitemap><loc>http://127.0.0.1/x.xml</loc></sitemap>"))

    def sites(**seeds: str) -> DataFrame:
        return Registry([Site(run, home, sitemap_urls=(f"{home}/{at}.xml",) if at else ()) for run, at in seeds.items()]).table(spark).withColumn("sitemaps", F.col("sitemap_urls"))

    def counted(found: DataFrame, runs: DataFrame) -> DataFrame:
        days = F.datediff(F.col("lastmod").cast("date"), F.lit("2026-01-01").cast("date"))
        n = found.groupBy("site_name").agg(F.sum("n").alias("discovered"), F.count("*").alias("urls"), F.sum(days).alias("days"))
        return runs.join(n, "site_name", "left").select(F.col("site_name").alias("run"), "complete", F.col("child_sitemaps").alias("children"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("discovered", "urls", "days")])

    whole = counted(*pipelines.walk_site_sitemaps(responses, sites(whole="whole", broken="broken", foreign="foreign", none=""))[:2])
    return whole.unionByName(counted(*pipelines.walk_site_sitemaps(responses, sites(capped="whole"), 1)[:2]))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE greatest(1.0, value) END AS min_delay, CASE WHEN event_id % 3 = 0 THEN 3.0 ELSE greatest(3.0, greatest(1.0, value)) END AS max_delay FROM events")
def effective_delay(spark, sf_dir):
    d = schedule.effective_delay(F.lit(1.0), F.lit(3.0), F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(greatest(0.0, round(value)), 20.0) WHEN 1 THEN 3.0 WHEN 2 THEN 3.0 WHEN 3 THEN least(60.0, 20.0) ELSE 0.0 END AS applied, CASE event_id % 5 WHEN 0 THEN round(value) > 20 WHEN 3 THEN true ELSE false END AS capped FROM events""")
def retry_after(spark, sf_dir):
    m = F.col("event_id") % 5
    header = F.when(m == 0, F.round("value").cast("int").cast("string")).when(m == 2, "not-a-value").when(m == 3, "Wed, 05 Aug 2026 00:01:00 GMT").when(m == 4, "-7")
    s = schedule.suspension(header, F.lit("2026-08-05 00:00:00").cast("timestamp"), F.lit(3.0), cap=20.0)
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * CAST(1.5 AS DOUBLE) AS slot_seconds FROM events")
def slot_plan(spark, sf_dir):
    return discovery.slots(table(spark, sf_dir, "events"), "user_id", "event_id", F.lit(1.5)).select("event_id", "slot_seconds")
