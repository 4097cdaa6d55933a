"""Mixing sources to target weights: whole passes, then a subset-sum fit of what remains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import NOT_SPACE, settled, table

WEIGHTS = (5.0, 2.0, 1.0)
#: A document counts at most so often, and so a source at most so many times its size.
MOST_PASSES = 3
#: Words that are left for the exact fit; the table of reachable sums has so many places.
EXACT_BUDGET = 1 << 16
BUCKETS = 256


def exact_fill(sizes: Sequence[int], counts: Sequence[int], budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each size, counts at most, to take for the largest sum within the budget."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    parent = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for size, count in zip(sizes, counts):
        count, chunk = min(count, budget // size), 1
        while count > 0 and not reach[budget]:
            part = min(chunk, count)
            count, chunk, step = count - part, chunk * 2, part * size
            new = reach[:-step] & ~reach[step:]
            parent[step:][new] = len(items)
            reach[step:] |= new
            items.append((size, part))
    at, taken = int(np.flatnonzero(reach)[-1]), {}
    while at:  # a sum's parent is the item that first reached it, so parents only go to earlier items
        size, part = items[parent[at]]
        taken[size] = taken.get(size, 0) + part
        at -= size * part
    return taken


def quotas(sizes: Sequence[int], counts: Sequence[int], budget: int, copies: int = 1, exact: int = EXACT_BUDGET) -> dict[int, int]:
    """Documents to take of each length, each at most `copies` times, so that their words come as near to the budget as can be found.

    Every length first gives its proportional share of all but `exact` words, rounded down; the longest lengths that fit then
    bring what is left down to `exact` words, and bounded-knapsack dynamic programming fits those. With one copy of each and over half the
    words to take, what is to be left out is fitted instead.
    """
    order = sorted(((int(s), int(c)) for s, c in zip(sizes, counts) if s > 0 and c > 0), reverse=True)
    whole = sum(s * c for s, c in order)
    if copies == 1 and 2 * budget > whole:
        out = quotas([s for s, _ in order], [c for _, c in order], max(0, whole - budget), 1, exact) if budget < whole else {}
        return {s: c - out.get(s, 0) for s, c in order}
    take = {s: c * max(0, budget - exact) // whole for s, c in order}
    left = budget - sum(s * q for s, q in take.items())
    for low in (exact // 2, 0):  # half the exact budget stays free, where lengths allow
        for s, c in order:
            if left > exact and s <= left:
                more = max(0, min(c * copies - take[s], (left - low) // s))
                take[s] += more
                left -= more * s
    spare = [(s, c * copies - take[s]) for s, c in order if s <= left and c * copies > take[s]]
    if left and spare:  # what is over `exact` here is less than any length that is spare
        for s, q in exact_fill([s for s, _ in spare], [c for _, c in spare], left).items():
            take[s] += q
    return take


def _ordered(sources: DataFrame) -> DataFrame:
    """Adds place, the row's number from 0 by ascending source, null last, without a single task for all."""
    spark = sources.sparkSession
    cut = settled(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("mid", F.monotonically_increasing_id()))
    sizes = sorted(tuple(r) for r in cut.groupBy(F.shiftright("mid", 33).alias("part")).count().collect())  # one row a partition
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = spark.createDataFrame(starts, "part long, start long")
    offset = (F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).alias("place")
    return cut.join(F.broadcast(starts), F.shiftright("mid", 33) == F.col("part")).select("key", "source", "source_size", offset)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """Adds target to (key, source, source_size): shares of all sizes by repeating weights, capped at most times the size.

    What the caps free is shared again by weight among the others until none is above its cap.
    """
    placed = settled(_ordered(sources).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    total, w = placed.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = (total or 0) / (w or 1), -1
    while True:
        full = F.col("source_size") * most < F.lit(level) * F.col("w")
        held, w, n = placed.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full)
        ).first()
        if not w or n == capped:
            break
        level, capped = (total - held) / w, n
    return placed.select("key", "source", "source_size", F.least(F.col("source_size").cast("double") * most, F.lit(float(level)) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row.

    size counts the words `[^\\x20\\x09-\\x0D]+` (null text: 0). A source's target is met by floor(target / source_size) whole passes
    and, for the rest, by more copies of documents chosen so that their lengths sum to it: their numbers come
    from the counts of documents by exact length (at most one row a source and length reaches a task), the documents of a
    length from the order of a seeded hash of doc_id and text. taken is size times the copies.
    A hot length is dealt over buckets of the hash, which keep its order. Null source: a source of its own, last in order.
    Rows alike in every column are told apart only by number. Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = settled(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("h"),
        )
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("bucket", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 56).cast("int"))
    )
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    goal = settled(targets(sources, weights, most))
    by_length = sized.where("size > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    by_length = settled(by_length)
    whole = F.when(F.col("source_size") > 0, F.least(F.round("target").cast("long"), F.col("source_size") * most)).otherwise(0)
    passes = F.when(F.col("source_size") > 0, F.expr("goal_words div source_size")).otherwise(0)
    plan = goal.withColumn("goal_words", whole).withColumn("passes", passes).withColumn("rest", F.expr("goal_words - passes * source_size"))

    def fit(part: pa.Table) -> pa.Table:
        rows = part.select(["size", "n"]).to_pydict()
        got = quotas(rows["size"], rows["n"], part.column("rest")[0].as_py(), part.column("copies")[0].as_py())
        count = dict(zip(rows["size"], rows["n"]))
        got = [(s, q // count[s], q % count[s]) for s, q in got.items() if q]
        columns = [pa.array([part.column("key")[0].as_py()] * len(got), pa.string())]
        return pa.table([*columns, *(pa.array([x[i] for x in got], pa.int64()) for i in range(3))], ["key", "size", "each", "quota"])

    rest = plan.where("rest > 0").select("key", "rest", (F.lit(most) - F.col("passes")).cast("int").alias("copies"))
    lengths = by_length.groupBy("key", "size").agg(F.sum("n").alias("n")).join(rest, "key")
    quota = lengths.groupBy("key").applyInArrow(fit, "key string, size long, each long, quota long")
    order = Window.partitionBy("key", "size").orderBy("bucket")
    ahead = by_length.withColumn("before", F.sum("n").over(order) - F.col("n"))
    open_ = ahead.join(quota, ["key", "size"]).select("key", "size", "bucket", "each", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))).alias("extra"))
    nth = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id"))
    chosen = sized.withColumn("nth", nth).join(open_, ["key", "size", "bucket"], "left")
    copies = F.col("passes") + F.coalesce("each", F.lit(0)) + F.when(F.col("nth") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    return chosen.join(plan.select("key", "source_size", "target", "passes"), "key").select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken")
    )


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
