"""Events that were sent again or share a record, charge or content item: which count, and which runs are sound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import components
from lodestone.sources.scratch import settled


def identified(events: DataFrame, run: str, event: str, order: str, payload: Sequence[str], keys: Sequence[Sequence[str]]) -> DataFrame:
    """Adds to events: same (how many rows repeat this run and event), conflict (whether such rows differ in payload), first (whether this is the row
    of its run and event that stays), group (the least event that a chain of shared keys reaches) and counted (the first of its group).

    keys are the secondary identities, each some columns; two events of a run share one if all its columns are equal and not null. Keys chain: an event
    that shares a record with one and a content item with another is one with both. Only counted rows may be summed. Of repeats the smallest
    (order, payload) stays. A run or event that is null identifies nothing: its rows count each.

    Each key adds a row an event, a star around the least event that has it, so a key that many events share costs its rows.
    """
    made = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    rows = settled(events.withColumn("_row", F.monotonically_increasing_id()).withColumn("_made", made))
    named = rows.where(F.col(run).isNotNull() & F.col(event).isNotNull())
    once = named.groupBy(run, event).agg(
        F.count("*").alias("same"), (F.min("_made") != F.max("_made")).alias("conflict"), F.min(F.struct(order, "_made", "_row")).alias("_first"), *(F.min(F.struct(*k)).alias(f"_key{n}") for n, k in enumerate(keys))
    )
    once = settled(once.withColumn("_node", F.struct(F.col(run).alias("r"), F.col("_first")[order].alias("o"), F.col(event).alias("e"))))
    stars = []
    for n, columns in enumerate(keys):
        # every row's key counts, also where repeats of an event have others
        held = named.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))).join(once.select(run, event, "_node"), [run, event])
        least = held.groupBy(run, *columns).agg(F.min("_node").alias("_least"))
        stars.append(held.select(run, *columns, "_node").distinct().join(least, [run, *columns]).where("_node <> _least").select(F.col("_node").alias("a"), F.col("_least").alias("b")))
    roots = components(reduce(DataFrame.union, stars)) if stars else None
    grouped = once.join(roots, F.col("_node") == F.col("node"), "left") if stars else once.withColumn("root", F.col("_node"))
    grouped = grouped.select(run, event, "same", "conflict", F.col("_first._row").alias("_kept"), F.coalesce("root", "_node").alias("_root"), "_node")
    full = rows.join(grouped, [run, event], "left")
    first = F.coalesce(F.col("_row") == F.col("_kept"), F.lit(True))
    counted = first & F.coalesce(F.col("_root") == F.col("_node"), F.lit(True))
    one = F.coalesce("same", F.lit(1)).alias("same"), F.coalesce("conflict", F.lit(False)).alias("conflict")
    return full.select(*events.columns, *one, first.alias("first"), F.coalesce(F.col("_root.e"), F.col(event)).alias("group"), counted.alias("counted"))


def runs(identified_: DataFrame, run: str, kind: str, status: str, started: str = "run_started", finished: str = "run_finished") -> DataFrame:
    """(run, attempted, status, duplicates, conflicts) of each run: attempted if it started; its status is that of its terminal event, and invalid if it has
    none or several, or an event came with different payloads; not_started if it never began.
    """
    ends = F.col("first") & (F.col(kind) == finished)
    per = identified_.where(F.col(run).isNotNull()).groupBy(run).agg(
        F.max((F.col(kind) == started)).alias("attempted"), F.count_if(ends).alias("_ends"), F.max(F.when(ends, F.col(status))).alias("_status"),
        F.count_if(~F.col("first") & ~F.col("conflict")).alias("duplicates"), F.count_if(~F.col("first") & F.col("conflict")).alias("conflicts"),
    )
    told = F.when(~F.col("attempted"), "not_started").when((F.col("_ends") != 1) | (F.col("conflicts") > 0) | F.col("_status").isNull(), "invalid").otherwise(F.col("_status"))
    return per.select(run, "attempted", told.alias("status"), "duplicates", "conflicts")
