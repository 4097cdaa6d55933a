"""Half-open intervals within a group: coalescing, depth, rereading; containment and overlap are in `sweep`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import sweep
from lodestone.operators.ordered import before, ranges


def coalesced(df: DataFrame, group: str) -> DataFrame:
    """Overlapping or touching intervals merged: (group, start, end, n). A large group is dealt over ranges (see ordered.before)."""
    order = ["start", "end"]
    rows = before(ranges(df.select(group, *order), [group, *order]), group, order, F.col("end"), "max", "reach")
    rows = rows.withColumn("new", F.when(F.col("reach") >= F.col("start"), 0).otherwise(1))
    # rows that are equal lie in one range, and only the first of them can be new
    islands = before(rows, group, order, F.col("new"), "sum", "past").withColumn("island", F.coalesce("past", F.lit(0)) + F.col("new"))
    return islands.groupBy(group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def depth(df: DataFrame, group: str) -> DataFrame:
    """The most intervals open at once in each group, by a sweep over their ends."""
    ends = df.select(group, F.col("start").alias("at"), F.lit(1).alias("step")).union(df.select(group, F.col("end"), F.lit(-1)))
    points = ends.groupBy(group, "at").agg(F.sum("step").alias("step"))
    summed = before(ranges(points, [group, "at"]), group, ["at"], F.col("step"), "sum", "past")
    return summed.groupBy(group).agg(F.max(F.coalesce("past", F.lit(0)) + F.col("step")).alias("most_open"))


def reread(df: DataFrame, group: str, order: str, width: int | None = None) -> DataFrame:
    """(group, id) of intervals that share a point with one before them in the order (see `sweep.reread`). width: once that of bins, no longer used."""
    return sweep.reread(df, group, order)
