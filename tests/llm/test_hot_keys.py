"""Joins and components with keys that hold a large part of all rows."""

from pyspark.sql import functions as F

from siltstone.llm.common import connected_components, join_counted, staged


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    named = staged(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "hot")
    assert named.agg(F.max("n")).first()[0] >= 3000
    got = {(r.k, r.id, r.top) for r in join_counted(rows, named, "k").collect()}
    assert got == {(r.k, r.id, r.top) for r in rows.join(named.drop("n"), "k").collect()} and len(got) == 9000


def test_components_of_stars_chains_and_pairs(spark):
    star = spark.range(1, 4001).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("a"))
    top = spark.range(10_000, 12_000).select(F.lit(20_000).cast("long").alias("b"), F.col("id").alias("a"))
    chain = spark.range(30_000, 30_040).select((F.col("id") + 1).alias("b"), F.col("id").alias("a"))
    edges = star.unionByName(top).unionByName(chain).repartition(4)
    got = {r.node: r.root for r in connected_components(edges, "stars").collect()}
    want = dict.fromkeys(range(4001), 0) | dict.fromkeys([*range(10_000, 12_000), 20_000], 10_000) | dict.fromkeys(range(30_000, 30_041), 30_000)
    assert got == want


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "none").count() == 0
