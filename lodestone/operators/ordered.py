"""Ordered computations: islands, running budgets, latest rows, seeded orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import settled


def ranges(df: DataFrame, order: Sequence[str | Column], number: int | None = None) -> DataFrame:
    """df cut into ranges of the order, each row with its range's number _part; written, so that every reader sees the same ranges."""
    cut = df.repartitionByRange(*([number] if number else []), *order)
    return settled(cut.withColumn("_part", F.spark_partition_id()))


def before(cut: DataFrame, group: str, order: Sequence[str], value: Column, how: str, name: str) -> DataFrame:
    """Adds to rows of `ranges([group, *order])` the last value, the sum or the max of the rows of their group before them; null if there are none.

    Windows run within a range and group; what the ranges before come to is added from one row a range, as only the first group of a range can have
    begun before it. These rows are broadcast: there are no more than ranges. So the rows are shuffled once to where their range's windows
    run, also if several values are asked for in turn.
    """
    own = Window.partitionBy("_part", group).orderBy(*order)
    past, earlier = own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group).orderBy("_part")
    rows = cut.withColumn("_value", value)
    if how == "last":
        rows = rows.withColumn("_first", F.row_number().over(own) == 1).withColumn("_within", F.lag("_value").over(own))
        ends = rows.groupBy("_part", group).agg(F.max_by("_value", F.struct(*order)).alias("_end"))
        start, both = F.lag("_end").over(earlier), F.when(F.col("_first"), F.col("_start")).otherwise(F.col("_within"))
    else:
        total = {"sum": F.sum, "max": F.max}[how]
        rows = rows.withColumn("_within", total("_value").over(past))
        ends = rows.groupBy("_part", group).agg(total("_value").alias("_end"))
        start = total("_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        both = F.coalesce(F.col("_start") + F.col("_within"), F.col("_start"), F.col("_within")) if how == "sum" else F.greatest("_start", "_within")
    carried = ends.withColumn("_start", start).withColumn("_nth", F.row_number().over(earlier)).where("_nth > 1")
    starts = F.broadcast(carried.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_start"))
    joined = rows.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn(name, both).drop("_p", "_g", "_start", "_within", "_first", "_value")


def islands(df: DataFrame, group: str, at: str, gap: float | int) -> DataFrame:
    """Adds island, from 1: rows of a group in order, a new one where `at` is over `gap` beyond the row before (see `before`)."""
    rows = before(ranges(df, [group, at]), group, [at], F.col(at), "last", "_last")
    rows = rows.withColumn("_new", F.when(F.col(at) - F.col("_last") <= gap, 0).otherwise(1))
    rows = before(rows, group, [at], F.col("_new"), "sum", "_past")
    return rows.withColumn("island", (F.coalesce("_past", F.lit(0)) + F.col("_new")).cast("long")).select(*df.columns, "island")


def running_total(df: DataFrame, order: Sequence[str], amount: str, name: str = "total") -> DataFrame:
    """The sum of amount up to and with each row in a total order over all rows, without bringing them to one task.

    Rows are cut into ranges of the order; sums within a range run on its own, and what the ranges before come to is added from one row a range.
    """
    cut = ranges(df, order)
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    past = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", past).select("_part", "_before")
    return cut.withColumn("_within", within).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds each row's number, from 1, in its group's order: as row_number does, but a large group is ranked by as many tasks as it has ranges.

    group and order together must tell rows apart, or those that they don't are numbered as they come.
    """
    cut = ranges(df, [*group, *order])
    within = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    of = F.struct(F.lit(0).alias("_"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)))
    edges = cut.groupBy("_part").agg(F.min(of).alias("_low"), F.max(of).alias("_high"))
    # only a range's first group can have begun before it, and only its last can go on: one or two rows a range
    at_edge = cut.join(F.broadcast(edges), "_part").withColumn("_of", of).where((F.col("_of").eqNullSafe(F.col("_low"))) | (F.col("_of").eqNullSafe(F.col("_high"))))
    counts = at_edge.groupBy("_part", "_of").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.col("_of").alias("_o"), F.sum("_n").over(earlier).alias("_before")).where("_before is not null")
    joined = cut.withColumn("_within", within).withColumn("_of", of).join(F.broadcast(starts), (F.col("_part") == F.col("_p")) & F.col("_of").eqNullSafe(F.col("_o")), "left")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_within")).select(*df.columns, name)


def within_budget(df: DataFrame, order: Sequence[str], amount: str, most: int) -> DataFrame:
    """Adds total, kept and exhausted_before: once the running total is over the budget it stays so, amounts being 0 or more."""
    run = running_total(df, order, amount)
    return run.withColumn("kept", F.col("total") <= most).withColumn("exhausted_before", F.col("total") - F.col(amount) > most)


def latest(df: DataFrame, group: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(F.max(F.struct(*order, *keep)).alias("_last")).select(group, *(F.col(f"_last.{c}") for c in [*order, *keep]))


def seeded(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Adds place: the rank by a seeded digest of the key within the group."""
    mark = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return placed(df.withColumn("_mark", mark), [group], ["_mark", key]).drop("_mark")


def reordered(base: DataFrame, target: DataFrame, group: str, member: str, at: str) -> DataFrame:
    """(group, common, reordered): whether the members that both sides have stand in another order."""
    both = base.select(group, member, F.col(at).alias("_b")).join(target.select(group, member, F.col(at).alias("_t")), [group, member])
    ranked = placed(placed(both, [group], ["_b", member], "_i"), [group], ["_t", member], "_j")
    return ranked.groupBy(group).agg(F.count("*").alias("common"), F.max(F.col("_i") != F.col("_j")).alias("reordered"))


def difference(df: DataFrame, group: str, order: Sequence[str], value: str, name: str = "delta") -> DataFrame:
    """The growth of a cumulative value since the row before; a fall, and a group's first row, are null."""
    rows = before(ranges(df, [group, *order]), group, order, F.col(value), "last", "_last")
    step = F.col(value) - F.col("_last")
    return rows.withColumn(name, F.when(step >= 0, step)).select(*df.columns, name)
