"""URL discovery: scope, sitemaps, frontiers and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import frontier, scans
from siltstone.staging import staged

CHILD_SITEMAPS = 10_000  # fetches of one run, a politeness bound of the feature


def scope_reason(url: Column, allowed_domains: Sequence[str], exclude: Sequence[str]) -> Column:
    """Why a URL is out of scope: its domain first, then the patterns; null if it is in scope."""
    out = F.when(F.lit(False), F.lit(""))
    if allowed_domains:
        out = out.when(~urls.host(url).isin(*[d.lower() for d in allowed_domains]), F.lit("domain_not_allowed"))
    if exclude:
        target = urls.scope_target(url)
        hit = F.lit(False)
        for glob in exclude:
            hit = hit | target.rlike(urls.glob_to_regex(glob))
        out = out.when(hit, F.lit("excluded_by_pattern"))
    return out


def with_scope(df: DataFrame, url_col: str, allowed_domains: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Adds ``scope_reason`` and ``scope_status``: eligible, out_of_scope (another domain) or excluded (by a pattern)."""
    reason = scope_reason(F.col(url_col), allowed_domains, exclude)
    status = F.when(F.col("scope_reason").isNull(), "eligible").when(F.col("scope_reason") == "domain_not_allowed", "out_of_scope").otherwise("excluded")
    return df.withColumn("scope_reason", reason).withColumn("scope_status", status)


def sitemap_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Guard for what a sitemap may make us fetch: http or https, and one of the hosts."""
    return urls.scheme(url).isin("http", "https") & urls.host(url).isin(*[h.lower() for h in hosts])


SITEMAP_DDL = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"


def parse_sitemaps(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Adds ``kind`` (urlset, index or malformed), ``entries`` (loc, lastmod) and ``children``.

    A document with any child location is an index and its URLs don't count.  Entries without a location are dropped.
    """
    x = F.from_xml(F.col(body_col), SITEMAP_DDL, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = bodies.withColumn("__x", x)
    children = F.filter(F.transform(F.coalesce("__x.sitemap", F.array().cast("array<struct<loc:string>>")), lambda s: F.trim(s["loc"])), lambda s: s.isNotNull() & (s != ""))
    entries = F.filter(
        F.transform(F.coalesce("__x.url", F.array().cast("array<struct<loc:string,lastmod:string>>")), lambda u: F.struct(F.trim(u["loc"]).alias("loc"), F.trim(u["lastmod"]).try_cast("timestamp").alias("lastmod"))),
        lambda u: u["loc"].isNotNull() & (u["loc"] != ""),
    )
    bad = F.col("__x").isNull() | F.col("__x._corrupt_record").isNotNull()
    df = df.withColumn("children", F.when(bad, F.array().cast("array<string>")).otherwise(children))
    kind = F.when(bad, "malformed").when(F.size("children") > 0, "index").otherwise("urlset")
    return df.withColumn("kind", kind).withColumn("entries", F.when(F.col("kind") == "urlset", entries).otherwise(F.array().cast("array<struct<loc:string,lastmod:timestamp>>"))).drop("__x")


def walk(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Breadth-first reach over ``links(src, dst)`` from ``seeds(node)``: ``node, depth``; without ``max_depth`` as far as links go.

    ``max_nodes`` is the run's page budget, spent in the order of a queue: within a level after the nodes that lead
    there, then by the link's ``pos``, where there is such a column, then by name.
    """
    spark = links.sparkSession
    placed = links if "pos" in links.columns else links.withColumn("pos", F.lit(0).cast("long"))
    start = seeds.select(F.lit("").alias("site_name"), "node", F.lit(0).alias("pos"))
    limits = None if max_nodes is None else spark.createDataFrame([("", max_nodes, None)], "site_name string, budget long, max_depth int")
    return frontier.walk_sites(placed.select("src", "dst", "pos"), start, limits, max_depth=max_depth)[0].select("node", "depth")


def gap_crawl(links: DataFrame, settings: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Pages that sites reach from their seeds over links within their domains, as far as depth and page budget go: ``site_name, node, depth, place, success``.

    ``settings``: site_name, gap_seeds, gap_depth, gap_pages, allowed_domains and allowed_content_types (lower case);
    ``links``: src, dst, pos (or none: by name), and site_name where links aren't the same for all.  ``pages`` (url,
    success, content_type) tells what fetching each gave; a page that isn't in it, or none at all, was fetched.  Pages
    that failed aren't followed; pages of a type that isn't allowed are left out.  Seeds always count.
    """
    settings = staged(settings.select("site_name", "gap_seeds", "gap_depth", "gap_pages", "allowed_domains", "allowed_content_types"), "settings")
    seeds = settings.select("site_name", F.posexplode("gap_seeds").alias("pos", "node"))
    limits = settings.select("site_name", F.col("gap_pages").alias("budget"), F.col("gap_depth").alias("max_depth"))
    follow = links if "pos" in links.columns else links.withColumn("pos", F.lit(0).cast("long"))
    known = None
    if pages is not None:
        known = staged(pages.groupBy("url").agg(F.bool_and("success").alias("success"), F.max(F.lower(F.trim(F.substring_index("content_type", ";", 1)))).alias("content_type")), "fetched")
        follow = follow.join(known.filter("not success").select(F.col("url").alias("src")), "src", "left_anti")

    def admit(rows: DataFrame) -> DataFrame:
        j = rows.join(settings.select("site_name", "allowed_domains", "allowed_content_types"), "site_name")
        j = j.filter((F.size("allowed_domains") == 0) | F.array_contains("allowed_domains", urls.host(F.col("node"))))
        if known is not None:
            j = j.join(known.select(F.col("url").alias("node"), "content_type"), "node", "left").filter(F.col("content_type").isNull() | (F.size("allowed_content_types") == 0) | F.array_contains("allowed_content_types", F.col("content_type"))).drop("content_type")
        return j.drop("allowed_domains", "allowed_content_types")

    reached, _ = frontier.walk_sites(follow, seeds, limits, admit)
    if known is None:
        return reached.withColumn("success", F.lit(True))
    return reached.join(known.select(F.col("url").alias("node"), "success"), "node", "left").select("site_name", "node", "depth", "place", F.coalesce("success", F.lit(True)).alias("success"))


def summary(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Long form of a run's counts: ``metric, n`` (discovered, eligible, and excluded:<reason>), with the ``by`` columns.

    ``weight`` names a column that says how often each row was found.
    """
    reason = F.concat(F.lit("excluded:"), F.coalesce("scope_reason", F.lit("unknown")))
    marks = F.array(F.lit("discovered"), F.when(F.col("scope_status") == "eligible", F.lit("eligible")).otherwise(reason))
    counted = scored.select(*by, (F.col(weight) if weight else F.lit(1)).cast("long").alias("__n"), F.explode(marks).alias("metric"))
    return counted.groupBy(*by, "metric").agg(F.sum("__n").alias("n"))


def cached_runs(runs: DataFrame, fingerprints: DataFrame, now: Column) -> DataFrame:
    """Sites whose last run may be used again: complete, same settings, and younger than the site's limit (zero: never).

    ``runs``: site_name, completed_at, complete, config_fingerprint; ``fingerprints``: site_name, fingerprint, ttl_hours.
    """
    last = runs.groupBy("site_name").agg(F.max_by(F.struct("completed_at", "complete", "config_fingerprint"), "completed_at").alias("r")).select("site_name", "r.*")
    age = F.unix_micros(now) - F.unix_micros("completed_at")
    hit = F.col("complete") & (F.col("config_fingerprint") == F.col("fingerprint")) & (F.col("ttl_hours") > 0) & (age < F.col("ttl_hours") * F.lit(3_600_000_000))
    return last.join(fingerprints, "site_name").withColumn("cached", F.coalesce(hit, F.lit(False)))


def slots(requests: DataFrame, host_col: str, order_col: str, min_delay: Column) -> DataFrame:
    """Adds ``slot_seconds``: when each request of a host may go, counted from the first, one delay apart; see ``hosts`` for delays that differ and suspensions."""
    return scans.numbered(requests, [host_col], [order_col], "__n", "slots").withColumn("slot_seconds", (F.col("__n") - 1) * min_delay).drop("__n")
