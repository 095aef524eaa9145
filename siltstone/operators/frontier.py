"""Breadth-first walks of many sites at once, in the order of a queue and within each site's budget."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import scans
from siltstone.staging import Growing, staged


def walk_sites(links: DataFrame, seeds: DataFrame, limits: DataFrame | None = None, admit: Callable[[DataFrame], DataFrame] | None = None, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each site's queue gives: ``(site_name, node, depth, place)``, and ``(site_name)`` of the sites whose budget cut it off.

    ``links``: src, dst, pos (the link's place on its page), and site_name where links aren't the same for all sites;
    ``seeds``: site_name, node, pos.  Nodes of a level follow the places of the nodes that lead to them, and then those
    of the links; ``place`` numbers a site's level from 1.  ``limits``: site_name, budget (nodes, seeds too) and
    max_depth, either of them null for none.  ``admit`` takes (site_name, node, ...) and gives the rows that may be
    followed.

    Links are staged once, with the first place of each.  A level is one join with them and one anti-join with what was
    seen, which is read as one table, so plans don't grow with the depth; the loop ends when no site has a level left.
    Nulls lead nowhere; a site without seeds has no nodes.
    """
    spark = links.sparkSession
    own = ["site_name"] if "site_name" in links.columns else []
    edges = staged(links.filter("src is not null and dst is not null").groupBy(*own, "src", "dst").agg(F.min("pos").alias("pos")), "links")
    node_type = dict(seeds.dtypes)["node"]
    found = Growing(spark, f"site_name string, node {node_type}, depth int, place long, kept boolean", "seen")

    def seen() -> DataFrame:
        return found.read().filter("kept").drop("kept")

    bound = limits.select("site_name", F.col("budget").cast("long").alias("budget"), F.col("max_depth").cast("int").alias("max_depth")) if limits is not None else None
    fresh = seeds.filter("node is not null").select("site_name", "node", F.lit(0).cast("long").alias("before"), F.col("pos").cast("long").alias("pos"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for depth in itertools.count():
        fresh = fresh if admit is None or not depth else admit(fresh)
        fresh = fresh.groupBy("site_name", "node").agg(F.min(F.struct("before", "pos")).alias("at"))
        if depth:
            fresh = fresh.join(seen(), ["site_name", "node"], "left_anti")
        order = ["before", "pos", "node"]
        fresh = fresh.select("site_name", "node", "at.*")
        if bound is None:
            level = fresh.repartitionByRange(ranges, "site_name", *order).sortWithinPartitions("site_name", *order).withColumn("place", F.monotonically_increasing_id())
        else:
            level = scans.numbered(fresh, ["site_name"], order, "place", "level")
            used = seen().groupBy("site_name").agg(F.count("*").alias("used"))
            rest = bound.join(used, "site_name", "left").select("site_name", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("rest"), "max_depth")
            level = level.join(rest, "site_name", "left").filter(F.col("max_depth").isNull() | (F.col("max_depth") >= depth))
        kept = F.lit(True) if bound is None else F.coalesce(F.col("place") <= F.col("rest"), F.lit(True))
        level = found.add(level.select("site_name", "node", F.lit(depth).alias("depth"), F.col("place").cast("long").alias("place"), kept.alias("kept"))).filter("kept")
        if depth == max_depth or level.isEmpty():
            return seen(), found.read().filter("not kept").select("site_name").distinct()
        ahead = level.select("site_name", F.col("node").alias("src"), F.col("place").alias("before"))
        fresh = ahead.join(edges, [*own, "src"]).select("site_name", F.col("dst").alias("node"), "before", "pos")
