"""Digests of whole tables that depend on the order, as trees over ranges of it, folded without one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ordinal
from lodestone.operators.ordered import before, ranges
from lodestone.sources.scratch import settled


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its byte length before it; null is `-`."""
    one = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws(",", *one), 256)


def _starts(key: Column, level: int, digits: int) -> Column:
    return F.startswith(F.sha2(key, 256), F.lit("0" * (digits * level)))


def tree(df: DataFrame, key: str, fields: Sequence[str], levels: int = 3, digits: int = 2) -> DataFrame:
    """(level, start, n, digest) of the tree over rows in the UTF-16 order of `key`; the one row above all `levels` is the table's digest.

    Level 1 folds the rows' digests from a key whose own SHA-256 begins with `digits` zeros up to the next such key; level l those of level l - 1,
    by l times as many zeros. So a range has 16 ** digits nodes on average, whatever the partitions, and a row that comes or goes changes
    its own ranges only (see `differing`). start is the first key's; it is empty for the first range. Rows that repeat are folded each, keys that repeat in the
    order of their digests. A null key counts as empty. Empty table: one row above all, of nothing.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    now = df.select(F.lit(0).alias("level"), name.alias("start"), F.lit(1).cast("long").alias("n"), leaf(*(F.col(f) for f in fields)).alias("digest"))
    found = None
    for level in range(1, levels + 1):
        rows = now.select("start", "n", "digest", ordinal(F.col("start")).alias("k"), F.lit(0).alias("all"))
        cut = ranges(rows, ["all", "k", "digest"])
        opens = F.when(_starts(F.col("start"), level, digits), F.struct("k", "start"))
        rows = before(cut, "all", ["k", "digest"], opens, "max", "_from").withColumn("_own", opens)
        # rows of one key begin together, whichever of them comes first
        node = F.coalesce(F.col("_own.start"), F.col("_from.start"), F.lit(""))
        order = F.sort_array(F.collect_list(F.struct("k", "digest")))
        per = rows.groupBy(node.alias("start")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(order, lambda x: x["digest"]), ""), 256).alias("digest"))
        now = settled(per.select(F.lit(level).alias("level"), "start", "n", "digest"))
        found = now if found is None else found.unionByName(now)
    order = F.sort_array(F.collect_list(F.struct(ordinal(F.col("start")).alias("k"), "digest")))
    top = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(order, lambda x: x["digest"]), ""), 256).alias("digest"))
    return found.unionByName(top.select(F.lit(levels + 1).alias("level"), F.lit("").alias("start"), "n", "digest"))


def differing(one: DataFrame, other: DataFrame, level: int = 1) -> DataFrame:
    """(start, one_n, other_n): ranges of two trees' level whose digests differ, or that one side lacks; what differs lies in them."""
    a, b = (t.where(F.col("level") == level).select("start", F.col("n").alias(f"{s}_n"), F.col("digest").alias(s)) for t, s in ((one, "one"), (other, "other")))
    return a.join(b, "start", "full_outer").where(~F.col("one").eqNullSafe(F.col("other"))).select("start", "one_n", "other_n")
