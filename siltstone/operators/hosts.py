"""When each request of a host may go: one delay apart, and not before what the host asked to be left alone for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import schedule, urls
from siltstone.operators import scans

REQUEST = ("host", "ordinal", "arrived_at", "delay", "status", "retry_after")


def schedule_requests(requests: DataFrame, max_delay: Column, cap: float = schedule.SUSPENSION_CAP, took: Column | None = None) -> DataFrame:
    """Adds ``starts_at``, ``suspended_for`` (seconds) and ``incomplete`` to requests of any kind and any number of hosts.

    ``requests``: host, ordinal (total within a host), arrived_at (timestamp at which it could go), delay (seconds to
    the host's next request), status and retry_after (the header) of what came back; ``took``: seconds until it came.  A
    request starts when it has arrived and the host is free.  The host is free ``delay`` after that, and after an answer
    of 429 or 503 not before its suspension has passed, for whatever comes next.  A header that says nothing gives
    ``max_delay``; one beyond ``cap`` gives the cap, and what comes later on that host is ``incomplete`` for this run.

    Null delays and times to answer count as zero; a request without an answer suspends nothing.  An empty table gives
    no rows.
    """
    micros = {"__a": F.unix_micros("arrived_at"), "__d": _micros(F.col("delay")), "__t": _micros(took) if took is not None else F.lit(0).cast("long")}
    hit = F.coalesce(F.col("status").isin(*schedule.SUSPENDING_STATUSES), F.lit(False))
    d = requests.withColumns(micros).withColumn("__s", F.when(hit, schedule.suspension(F.col("retry_after"), F.col("arrived_at"), max_delay, cap)))
    d = d.withColumn("suspended_for", F.col("__s.applied")).withColumn("__width", F.greatest("__d", F.when(hit, F.col("__t") + _micros(F.col("suspended_for"))).otherwise(0)))
    # The host is free at max(free, arrived) + width.
    out = scans.later_of(d, ["host"], ["ordinal"], F.col("__width"), F.col("__a") + F.col("__width"), "__free", {"incomplete": F.col("__s.capped")}, "schedule")
    return out.withColumn("starts_at", F.timestamp_micros(F.greatest("__a", "__free"))).drop(*micros, "__s", "__width", "__free")


def _micros(seconds: Column) -> Column:
    return F.coalesce(F.round(seconds.cast("double") * 1e6).cast("long"), F.lit(0))


def discovery_requests(sites: DataFrame, places: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """Requests of a discovery run: each site's robots rules, then its sitemaps in the order of the queue.

    ``sites``: site_name, robots_url, delay; ``places``: site_name, node, depth, place; ``responses``: url, status and,
    if it is known, retry_after.
    """
    given = responses.select("url", "status", (F.col("retry_after") if "retry_after" in responses.columns else F.lit(None).cast("string")).alias("retry_after"))
    robots = sites.select("site_name", F.col("robots_url").alias("url"), F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("place"), "delay")
    maps = places.join(sites.select("site_name", "delay"), "site_name").select("site_name", F.col("node").alias("url"), "depth", "place", "delay")
    wanted = robots.unionByName(maps).join(given, "url", "left")
    return wanted.select("site_name", "url", urls.host(F.col("url")).alias("host"), F.struct("depth", "place", "site_name", "url").alias("ordinal"), now.alias("arrived_at"), "delay", "status", "retry_after")


def render_slots(due: DataFrame, log: DataFrame, sites: DataFrame, now: Column, max_delay: Column) -> DataFrame:
    """Due records (site_name, canonical_url, source_url, rank) with ``starts_at`` and ``incomplete``, behind the requests of ``log`` on the same hosts.

    ``log``: what ``discovery_requests`` or earlier renders gave, with host, ordinal, arrived_at, delay, status and
    retry_after.  A host's cap that was hit leaves its pending records incomplete for this run.
    """
    place = F.struct(F.lit(1).alias("phase"), F.col("rank").cast("long").alias("n"), F.col("canonical_url").alias("url"))
    wanted = due.join(sites.select("site_name", F.col("delay").alias("__delay")), "site_name").select("site_name", "canonical_url", urls.host(F.col("source_url")).alias("host"), place.alias("ordinal"), now.alias("arrived_at"), F.col("__delay").alias("delay"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("retry_after"))
    before = scans.numbered(log, ["host"], ["ordinal"], "n", "log")
    earlier = before.select(F.lit(None).cast("string").alias("site_name"), F.lit(None).cast("string").alias("canonical_url"), "host", F.struct(F.lit(0).alias("phase"), F.col("n").cast("long").alias("n"), F.lit("").alias("url")).alias("ordinal"), "arrived_at", "delay", "status", "retry_after")
    return schedule_requests(earlier.unionByName(wanted), max_delay).filter("canonical_url is not null").select("site_name", "canonical_url", "host", "starts_at", "incomplete")
