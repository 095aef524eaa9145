"""Settings of many sites as a table, and what they say about URLs: one plan, however many sites there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls


def scope_reason(url: Column, domains: Column, patterns: Column) -> Column:
    """As ``discovery.scope_reason``, with a row's own domains (lower case; none: any) and patterns (regexes)."""
    target = urls.scope_target(url)
    foreign = (F.size(domains) > 0) & ~F.array_contains(domains, urls.host(url))
    hit = F.exists(patterns, lambda p: F.regexp_like(target, p))
    return F.when(F.coalesce(foreign, F.lit(False)), "domain_not_allowed").when(F.coalesce(hit, F.lit(False)), "excluded_by_pattern")


def with_scope(df: DataFrame, sites: DataFrame, url_col: str) -> DataFrame:
    """Adds ``scope_reason`` and ``scope_status`` by the settings of each row's ``site_name``; rows of unknown sites are left out."""
    j = df.join(sites.select("site_name", F.col("allowed_domains").alias("__d"), F.col("exclude_regexes").alias("__p")), "site_name")
    j = j.withColumn("scope_reason", scope_reason(F.col(url_col), F.col("__d"), F.col("__p"))).drop("__d", "__p")
    return j.withColumn("scope_status", F.when(F.col("scope_reason").isNull(), "eligible").when(F.col("scope_reason") == "domain_not_allowed", "out_of_scope").otherwise("excluded"))


def sitemap_seeds(sites: DataFrame, sitemaps: str) -> DataFrame:
    """``site_name, node, pos`` of the sitemaps in column ``sitemaps``, each where it stands first."""
    return sites.select("site_name", F.posexplode(sitemaps).alias("pos", "node")).groupBy("site_name", "node").agg(F.min("pos").alias("pos"))


def sitemap_hosts(sites: DataFrame, sitemaps: str) -> DataFrame:
    """``site_name, hosts``: the allowed domains, else the hosts of the given sitemaps."""
    given = F.array_distinct(F.transform(sitemaps, lambda s: urls.host(s)))
    return sites.select("site_name", F.when(F.size("allowed_domains") > 0, F.col("allowed_domains")).otherwise(given).alias("hosts"))


def may_fetch(url: Column, hosts: Column) -> Column:
    """Guard for what a sitemap may make us fetch: http or https, and one of the hosts."""
    return urls.scheme(url).isin("http", "https") & F.array_contains(hosts, urls.host(url))
