"""When a page is due, how long to wait, and what a host asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the refresh policy.
EXTRACTOR_VERSION = "2"
MAX_RETRIES = 5
BACKOFF_BASE, BACKOFF_CAP = 3600, 86400
SUSPENSION_CAP = 3600.0
SUSPENDING_STATUSES = (429, 503)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(float(BACKOFF_BASE)) * F.pow(F.lit(2.0), attempts), F.lit(float(BACKOFF_CAP)))


def next_retry(retry_count: Column, now: Column) -> Column:
    """(retry_count, retry_after, counted) after one more attempt without success; beyond the cap there is no next time."""
    n = retry_count + 1
    over = n > MAX_RETRIES
    at = F.timestamp_seconds(F.unix_micros(now) / 1e6 + backoff_seconds(n))
    return F.struct(n.cast("int").alias("retry_count"), F.when(~over, at).alias("retry_after"), (~over).alias("counted"))


def decide_render(r: dict[str, Column], now: Column, trust_lastmod: Column, audit_days: Column, force: Column, retry_when_due: bool = False) -> Column:
    """(mode, reason) of a record that is due, else null; the first rule that applies decides.

    ``r`` has retry_after, retry_count, last_rendered_at, sitemap_lastmod, extractor_version and last_attempt_at.
    ``retry_when_due`` also makes a record due whose retry time has come; without it such a record waits for its audit.
    """

    def due(mode: str, reason: str) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))

    anchor = F.coalesce(r["last_attempt_at"], r["last_rendered_at"])
    late = F.unix_micros(now) >= F.unix_micros(anchor) + audit_days.cast("long") * F.lit(86_400_000_000)
    out = (
        F.when(force, due("write_only", "forced"))
        .when(r["retry_after"] > now, F.lit(None))
        .when((r["retry_count"] > MAX_RETRIES) & r["last_rendered_at"].isNull(), F.lit(None))
        .when(r["last_rendered_at"].isNull(), due("write_only", "initial_backfill"))
        .when(trust_lastmod & (r["sitemap_lastmod"] > r["last_rendered_at"]), due("write_only", "lastmod_changed"))
    )
    if retry_when_due:
        out = out.when(r["retry_after"] <= now, due("enabled", "retry_due"))
    return out.when(~r["extractor_version"].eqNullSafe(F.lit(EXTRACTOR_VERSION)), due("enabled", "extractor_version_stale")).when(late, due("enabled", "scheduled_audit"))


def effective_delay(low: Column, high: Column, crawl_delay: Column) -> Column:
    """(min_delay, max_delay): a host's crawl delay raises both."""
    least = F.when(crawl_delay.isNull(), low).otherwise(F.greatest(low, crawl_delay))
    return F.struct(least.alias("min_delay"), F.when(crawl_delay.isNull(), high).otherwise(F.greatest(high, least)).alias("max_delay"))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, zero at least: a number, or an HTTP date against ``now``; else null."""
    v = F.trim(value)
    number = F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(v, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(now)) / 1e6
    asked = F.coalesce(number, until)
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), asked))


def suspension(value: Column, now: Column, max_delay: Column, cap: float = SUSPENSION_CAP) -> Column:
    """(applied, capped): what is waited after a suspending answer; a header that says nothing asks for ``max_delay``."""
    asked = retry_after_seconds(value, now)
    return F.struct(F.when(asked.isNull(), max_delay).otherwise(F.least(asked, F.lit(cap))).alias("applied"), F.coalesce(asked > cap, F.lit(False)).alias("capped"))
