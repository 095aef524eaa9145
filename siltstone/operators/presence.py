"""In which of a site's last complete discovery runs each page was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENCE = "site_name string, canonical_url string, mask long, last_found_at timestamp"
KEPT = (1 << 62) - 1  # runs that are remembered


def updated(held: DataFrame, found: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """The table (``PRESENCE``) after one run of each site in ``runs`` (site_name, complete).

    A bit of ``mask`` stands for a complete run, the lowest for the last one.  A complete run shifts the masks of its
    site and sets the lowest bit of what it found.  An incomplete run says nothing about what it didn't find: it shifts
    nothing, and what it found counts as found in the run before it.  Sites without a run stay as they are; pages stay
    for good.
    """
    fresh = found.select("site_name", "canonical_url").distinct().withColumn("found", F.lit(True))
    j = held.join(fresh, ["site_name", "canonical_url"], "full_outer").join(runs.select("site_name", "complete"), "site_name", "left")
    found_bit = F.when(F.col("found"), 1).otherwise(0).cast("long")
    old = F.coalesce("mask", F.lit(0)).cast("long")
    shifted = F.when(F.col("complete"), F.shiftleft(old, 1).bitwiseAND(F.lit(KEPT))).otherwise(old)
    mask = F.when(F.col("complete").isNull(), F.col("mask")).otherwise(shifted.bitwiseOR(found_bit))
    at = F.when(F.col("found") & F.col("complete").isNotNull(), now).otherwise(F.col("last_found_at"))
    return j.select("site_name", "canonical_url", mask.alias("mask"), at.alias("last_found_at")).filter("mask is not null")


def state(mask: Column, grace: Column) -> Column:
    """present, back (found again after it was missing), missing, or inactive_candidate: not found in the last ``grace`` complete runs."""
    lately = mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), grace.cast("int")) - 1)
    here = mask.bitwiseAND(F.lit(1)) == 1
    before = mask.bitwiseAND(F.lit(2)) == 2
    return F.when(here & ~before & (mask > 1), "back").when(here, "present").when(lately == 0, "inactive_candidate").otherwise("missing")


def states(held: DataFrame, sites: DataFrame) -> DataFrame:
    """``site_name, canonical_url, state, last_found_at`` by each site's ``inactive_grace_cycles``."""
    j = held.join(sites.select("site_name", "inactive_grace_cycles"), "site_name")
    return j.select("site_name", "canonical_url", state(F.col("mask"), F.col("inactive_grace_cycles")).alias("state"), "last_found_at")
