"""Picking what to work on: ranges, seeded splits, and greedy runs over an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import before, ranges, seeded


def within(**ranges: tuple[float | None, float | None]) -> Column:
    """All named columns within their bounds, both included; a bound that is None does not bind."""
    terms = F.lit(True)
    for name, (low, high) in ranges.items():
        if low is not None:
            terms = terms & (F.col(name) >= low)
        if high is not None:
            terms = terms & (F.col(name) <= high)
    return terms


def tuning_split(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Adds part: the first of each group by a seeded order is for tuning, the rest held out."""
    return seeded(df, group, key, seed).withColumn("part", F.when(F.col("place") == 1, "tuning").otherwise("held_out")).drop("place")


def greedy_pairs(df: DataFrame, group: str, order: str, value: str, accept: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, first, second) of `order` values: down each group's order, a row and the next are a pair if accept(value, next value), and both are used
    up; else the row alone is passed over. order tells the rows of a group apart.

    A row can only be met by the one right before it, so in a run of rows each accepted with the one before, every other one closes a pair: the
    parity of the distance to the last row that is not accepted decides. That distance adds up over ranges (see `ordered.before`), so a
    large group is worked on by as many tasks as it has ranges.
    """
    cut = ranges(df.select(group, order, value), [group, order])
    rows = before(cut, group, [order], F.struct(F.col(order).alias("at"), F.col(value).alias("value")), "last", "_prev")
    met = F.coalesce(F.col("_prev").isNotNull() & accept(F.col("_prev.value"), F.col(value)), F.lit(False))
    rows = before(rows.withColumn("_met", met), group, [order], F.lit(1), "sum", "_n").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = before(rows, group, [order], F.when(~F.col("_met"), F.col("_n")), "max", "_break")
    closes = F.col("_met") & ((F.col("_n") - F.col("_break")) % 2 == 1)
    return rows.where(closes).select(group, F.col("_prev.at").alias("first"), F.col(order).alias("second"))
