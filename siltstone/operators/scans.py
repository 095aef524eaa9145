"""Running values along an order, by group, where a group may be larger than what one task should hold.

Rows are dealt out by ranges of (group, order), so a large group lies in several ranges.  Each range works out its own
running values and one summary for each group; summaries, of which a group has at most as many as there are ranges, are
combined in the order of the ranges and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.staging import staged

RANGE = "__range"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows, staged, with the range of (``by``, ``order``) each is in; rows that are equal there are in one range."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(ranges, *by, *order).withColumn(RANGE, F.spark_partition_id()), label)


def _within(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "number", label: str = "numbered") -> DataFrame:
    """Adds the row's number in its group, from 1.  ``order`` must be total."""
    r = ranged(df, by, order, label)
    before = r.groupBy(RANGE, *by).agg(F.count("*").alias("__n")).select(RANGE, *by, F.coalesce(F.sum("__n").over(_earlier(by)), F.lit(0)).alias("__before"))
    own = r.withColumn(name, F.row_number().over(Window.partitionBy(RANGE, *by).orderBy(*order)))
    return own.join(before, [RANGE, *by]).withColumn(name, F.col(name) + F.col("__before")).drop(RANGE, "__before")


def later_of(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Column, floor: Column, name: str, marks: dict[str, Column] | None = None, label: str = "scan") -> DataFrame:
    """Adds ``name``: what ``x = max(x + step, floor)`` holds before each row, over the group's rows in order (null before the first).

    After i rows that is the largest of ``floor_j + step_(j+1) + ... + step_i``, which is a running sum of steps and a
    running maximum of floors less that sum, so it needs no loop.  ``marks`` adds for each name whether its condition
    held in an earlier row of the group.  ``order`` must be total; steps and floors are whole numbers and not null.
    """
    marks = marks or {}
    r = ranged(df.withColumn("__step", step.cast("long")).withColumn("__floor", floor.cast("long")).withColumns({f"__m_{k}": F.coalesce(c, F.lit(False)) for k, c in marks.items()}), by, order, label)
    w, before = _within(by, order), _earlier(by)
    r = r.withColumn("__sum", F.sum("__step").over(w)).withColumn("__top", F.max(F.col("__floor") - F.col("__sum")).over(w))
    # Of each range: the sum of its steps, the top within it, and what was marked.
    ends = r.groupBy(RANGE, *by).agg(F.sum("__step").alias("__s"), F.max("__top").alias("__t"), *[F.max(f"__m_{k}").alias(f"__o_{k}") for k in marks])
    ends = ends.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    ends = ends.select(RANGE, *by, "__before", F.max(F.col("__t") - F.col("__before")).over(before).alias("__held"), *[F.coalesce(F.max(f"__o_{k}").over(before), F.lit(False)).alias(f"__o_{k}") for k in marks])
    j = r.join(ends, [RANGE, *by])
    last = Window.partitionBy(RANGE, *by).orderBy(*order)
    top = F.greatest(F.lag("__top").over(last), F.col("__held") + F.col("__before"))
    out = j.withColumn(name, top + F.coalesce(F.lag("__sum").over(last), F.lit(0)))
    for k in marks:
        earlier = F.max(f"__m_{k}").over(last.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(k, F.coalesce(earlier, F.lit(False)) | F.col(f"__o_{k}"))
    return out.drop(RANGE, "__step", "__floor", "__sum", "__top", "__before", "__held", *[f"__m_{k}" for k in marks], *[f"__o_{k}" for k in marks])
