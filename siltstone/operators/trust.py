"""Whether a site's lastmod may be trusted, from what was observed of its pages and not from a setting alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATIONS = "site_name string, canonical_url string, observed_at timestamp, lastmod timestamp, content_hash string"
RESULTS = "site_name string, starts_at timestamp, ends_at timestamp, sampled long, lastmod_changed long, with_content long, content_changed long, with_lastmod long, long_enough boolean, trusted boolean, measured_at timestamp"
SAMPLE = 50  # pages of a site that are looked at, or all if there are fewer
# Pages whose lastmod must have changed, and the share, in tenths, that must agree each way.
LEAST_CHANGED, LEAST_TENTHS = 10, 9


def observe(manifest: DataFrame, now: Column) -> DataFrame:
    """What the manifest says of each rendered eligible page now, as rows for the log."""
    rendered = manifest.filter("scope_status = 'eligible' and content_hash is not null")
    return rendered.select("site_name", "canonical_url", now.alias("observed_at"), F.col("sitemap_lastmod").alias("lastmod"), "content_hash")


def sample(log: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``site_name, canonical_url`` of the ``size`` pages of each site with the smallest digests: the same ones however often it is drawn."""
    pages = log.select("site_name", "canonical_url").distinct()
    digest = F.sha2(F.concat_ws(" ", "site_name", "canonical_url"), 256)
    w = Window.partitionBy("site_name").orderBy("digest", "canonical_url")  # each task keeps that many before rows are dealt out
    return pages.withColumn("digest", digest).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size).select("site_name", "canonical_url")


def measure(log: DataFrame, windows: DataFrame, now: Column, size: int = SAMPLE) -> DataFrame:
    """A row of ``RESULTS`` for each row of ``windows`` (site_name, starts_at, ends_at, ttl_hours, audit_days).

    Each observation is paired with the page's one before it, and belongs to the window that it lies in (from its start
    up to, and without, its end).  A page's lastmod agrees with its content if each change of the one came with a change
    of the other between the same two observations, and the other way round; null is a value.  Trusted is a site whose
    window spans a cache time and an audit, in which ten sampled pages or more changed their lastmod, nine in ten of
    these with their content, and nine in ten of those that changed their content with their lastmod.
    """
    drawn = log.join(sample(log, size), ["site_name", "canonical_url"])
    w = Window.partitionBy("site_name", "canonical_url").orderBy("observed_at", "content_hash", "lastmod")
    pairs = drawn.withColumn("before", F.lag(F.struct("lastmod", "content_hash")).over(w))
    changed, content = ~F.col("lastmod").eqNullSafe(F.col("before.lastmod")), ~F.col("content_hash").eqNullSafe(F.col("before.content_hash"))
    pairs = pairs.select("site_name", "canonical_url", "observed_at", *[(F.col("before").isNotNull() & c).alias(n) for n, c in (("m", changed), ("c", content))])
    spans = windows.select("site_name", "starts_at", "ends_at", "ttl_hours", "audit_days")
    inside = pairs.join(spans, "site_name").filter((F.col("observed_at") >= F.col("starts_at")) & (F.col("observed_at") < F.col("ends_at")))
    pages = inside.groupBy("site_name", "starts_at", "ends_at", "canonical_url").agg(F.bool_or("m").alias("m"), F.bool_or("c").alias("c"), F.bool_and(~F.col("m") | F.col("c")).alias("forth"), F.bool_and(~F.col("c") | F.col("m")).alias("back"))
    counts = pages.groupBy("site_name", "starts_at", "ends_at").agg(
        F.count("*").alias("sampled"), F.count_if("m").alias("lastmod_changed"), F.count_if(F.col("m") & F.col("forth")).alias("with_content"), F.count_if("c").alias("content_changed"), F.count_if(F.col("c") & F.col("back")).alias("with_lastmod")
    )
    names = ("sampled", "lastmod_changed", "with_content", "content_changed", "with_lastmod")
    out = spans.join(counts, ["site_name", "starts_at", "ends_at"], "left").select("site_name", "starts_at", "ends_at", "ttl_hours", "audit_days", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    span = F.unix_micros("ends_at") - F.unix_micros("starts_at")
    needed = F.col("ttl_hours") * F.lit(3_600_000_000) + F.col("audit_days").cast("long") * F.lit(86_400_000_000)
    agree = (10 * F.col("with_content") >= LEAST_TENTHS * F.col("lastmod_changed")) & (10 * F.col("with_lastmod") >= LEAST_TENTHS * F.col("content_changed"))
    out = out.withColumn("long_enough", span >= needed).withColumn("trusted", F.col("long_enough") & (F.col("lastmod_changed") >= LEAST_CHANGED) & agree)
    return out.select("site_name", "starts_at", "ends_at", *names, "long_enough", "trusted", now.alias("measured_at"))


def latest(results: DataFrame) -> DataFrame:
    """``site_name, trusted`` of each site's last measurement: the latest window, and of several of one window the one made last."""
    return results.groupBy("site_name").agg(F.max_by("trusted", F.struct("ends_at", "measured_at")).alias("trusted"))


def earned(sites: DataFrame, results: DataFrame) -> DataFrame:
    """The site table, in which a site's lastmod counts only where its setting says so and its last measurement bears it out."""
    return sites.join(latest(results), "site_name", "left").withColumn("trust_lastmod", F.col("trust_lastmod") & F.coalesce("trusted", F.lit(False))).drop("trusted")
