"""Bounded expansion over a reference graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import settled


def impact(edges: DataFrame, roots: DataFrame, most_depth: int) -> tuple[DataFrame, bool]:
    """Reverse reachability over (src, dst): edges as (dst, src, depth), each target's at the depth it is first met, and whether more lay beyond.

    Level by level, nodes that were met before are left out, so cycles end. Each level is written before the next, which keeps plans short.
    """
    edges = settled(edges.select("src", "dst").distinct())
    front = settled(roots.select(F.col("node")).distinct())
    met, found = front, None
    for depth in range(most_depth + 1):
        level = settled(edges.join(front, edges["dst"] == front["node"], "left_semi").withColumn("depth", F.lit(depth)))
        found = level if found is None else found.unionByName(level)
        front = settled(level.select(F.col("src").alias("node")).distinct().join(met, "node", "left_anti"))
        if front.isEmpty():
            return found.select("dst", "src", "depth"), False
        met = met.union(front)
    beyond = not edges.join(front, edges["dst"] == front["node"], "left_semi").isEmpty()
    return found.select("dst", "src", "depth"), beyond


def ancestors(parents: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) over (node, parent), distance the shortest; ways up end where nothing new is met, or beyond most_depth if that is given."""
    step = settled(parents.select("node", F.col("parent").alias("ancestor")).where("parent is not null").distinct().withColumn("distance", F.lit(1)))
    found = step
    up = parents.select(F.col("node").alias("ancestor"), "parent").where("parent is not null")
    for distance in count(2):
        if most_depth is not None and distance > most_depth:
            break
        step = step.join(up, "ancestor").where("parent <> node").select("node", F.col("parent").alias("ancestor")).distinct()
        step = settled(step.join(found, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)))
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (of one type that orders) as rows (node, root), root the smallest node.

    Large-star and small-star steps in turn, each round settled; stops once a round changes nothing.
    Edges to themselves are ignored; nodes without edges have no row.
    """
    now = settled(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = settled(small.where("u <> v").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def provenance(kind: str = "kind", text: str = "text", qualified: str = "qualified_name") -> Column:
    """How a reference was found: invocation, type or member for semantic ones, whole or member name for lexical ones."""
    lexical = F.when(F.col(text) == F.col(qualified), "lexical-qualified-name").otherwise("lexical-member-name")
    return F.when(F.col(kind) == "lexical", lexical).when(F.col(kind).isin("invocation", "type"), F.concat(F.lit("semantic-"), F.col(kind))).otherwise("semantic-member")
