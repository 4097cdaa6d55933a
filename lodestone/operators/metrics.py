"""Ratios with denominators, latency figures, fixed pivots, and merges of partial reports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lines, ratio
from lodestone.operators.ordered import placed, running_total
from lodestone.operators.textdiff import split_lines
from lodestone.sources.scratch import settled

WORD = re.compile("[a-z]+")


def ratio_of(df: DataFrame, by: Sequence[str], num: Column, den: Column) -> DataFrame:
    """num, den and value of each group; conditions and amounts that are null count for neither."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(num), F.lit(0)).alias("num"), F.coalesce(F.sum(den), F.lit(0)).alias("den")).withColumn("value", ratio(F.col("num"), F.col("den")))


def quantiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, median, p95, most): the exact median (mean of the middle two) and the nearest-rank p95 of values that are not null.

    Values are ranked over ranges, so that no task holds a group's values; groups without a value have no row.
    """
    ranked = placed(df.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    counts = ranked.groupBy(*by).agg(F.count("*").alias("n"))
    both = ranked.join(counts, list(by))
    middle = F.col("place").between(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))
    p95 = F.col("place") == F.expr("(95 * n + 99) div 100")
    return both.groupBy(*by).agg(F.any_value("n").alias("n"), F.avg(F.when(middle, F.col(value))).alias("median"), F.max(F.when(p95, F.col(value))).alias("p95"), F.max(value).alias("most"))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """The quantiles of each group, n 0 and nulls for one without a value."""
    groups = df.select(by).distinct()
    return groups.join(quantiles(df, [by], value), by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def statuses(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """A column for each of the fixed values, zero-filled."""
    return df.groupBy(by).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def map_sum(df: DataFrame, by: Sequence[str], json: str) -> DataFrame:
    """(by, key, total, n): sums over all rows of the numbers in a JSON object, by key."""
    entries = df.select(*by, F.explode(F.from_json(json, "map<string,string>")).alias("key", "v"))
    return entries.groupBy(*by, "key").agg(F.sum(F.expr("try_cast(v as bigint)")).alias("total"), F.count("*").alias("n"))


def best_by_median(df: DataFrame, by: str, option: str, value: str, strength: dict[str, int] | None = None) -> DataFrame:
    """Each group's option with the lowest median, ties to the one of greater strength if that is given, then to the smaller option."""
    medians = quantiles(df, [by, option], value).select(by, option, "median")
    rank = F.coalesce(*(F.when(F.col(option) == k, v) for k, v in strength.items()), F.lit(0)) if strength else F.lit(0)
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("median"), rank.desc(), F.col(option)))
    return medians.withColumn("_n", best).where("_n = 1").drop("_n")


def complete(df: DataFrame, by: str, fine: Column) -> DataFrame:
    """(by, n, complete): whether all rows of a group are fine; null is not."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("complete"))


def merged(df: DataFrame, by: str | Sequence[str], id_: str, order: Sequence[str], items: str, flag: Column) -> DataFrame:
    """Parts of an entity, told by one key or several, as one row: the first part by order, the sorted distinct items, whether all have the flag."""
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(
        F.min(F.struct(*order, id_)).getField(id_).alias("first"), F.sort_array(F.collect_set(items)).alias("items"), F.bool_and(flag).alias("all_flagged"), F.count("*").alias("parts")
    )


def coverage(df: DataFrame, by: str) -> DataFrame:
    """Partial coverage reports as one: analysed and excluded by maximum, failed and unknown by sum, notes as a set, completeness by and."""
    return df.groupBy(by).agg(
        F.max("analysed").alias("analysed"), F.max("excluded").alias("excluded"), F.sum("failed").alias("failed"), F.sum("unknown").alias("unknown"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("notes")))), ",").alias("notes"), F.bool_and("complete").alias("complete"),
    )


def evict(df: DataFrame, age: str, size: str, key: str, most: int, protected: DataFrame) -> DataFrame:
    """What must go for the rest to fit in `most`: the oldest first, the protected never. See ordered.running_total for the sums."""
    free = df.join(protected.select(key), key, "left_anti")
    over = df.agg((F.sum(size) - most).alias("over"))
    return running_total(free, [age, key], size).crossJoin(F.broadcast(over)).where(F.col("total") - F.col(size) < F.col("over")).drop("over", "total")


#: Distinct words that a task counts at once.
MOST_WORDS = 1 << 17


def word_counts(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(name, n, line_n, doc_n) of the words `[a-z]+` that names has: how often they come, on how many lines (key, line) and in how many keys.

    Texts whose key no other row has are counted a chunk of texts at a time, so that a row for each chunk's distinct words is left. Only rows that share
    a key, null included, meet by key and line.
    """
    again = settled(docs.groupBy(F.col(key).alias("_k")).count().where("count > 1").select("_k"))
    same = F.col(key).eqNullSafe(F.col("_k"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, line_n, doc_n = Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([c[x] for x in n], pa.int64()) for c in (n, line_n, doc_n))], ["name", "n", "line_n", "doc_n"])
            for c in (n, line_n, doc_n):
                c.clear()
            return rows

        for batch in batches:
            for i in range(batch.num_rows):
                held = set()
                for line in split_lines(batch.column(1)[i].as_py()):
                    words = WORD.findall(line)
                    n.update(words)
                    own = set(words)
                    line_n.update(own)
                    held |= own
                if batch.column(0)[i].as_py():
                    doc_n.update(held)
                if len(n) > MOST_WORDS:
                    yield flush()
        yield flush()

    alone = docs.join(again, same, "left_anti").select(F.col(key).isNotNull().alias("there"), text)
    counted = alone.mapInArrow(count, "name string, n long, line_n long, doc_n long").join(names, "name", "left_semi")
    each = docs.join(again, same, "left_semi").select(key, F.posexplode(lines(F.col(text))).alias("line", "t"))
    words = each.select(key, "line", F.explode(F.split("t", "[^a-z]+")).alias("name")).join(names, "name", "left_semi")
    by_doc = words.groupBy("name", key, "line").agg(F.count("*").alias("n")).groupBy("name", key).agg(F.sum("n").alias("n"), F.count("*").alias("line_n"))
    by_doc = by_doc.select("name", "n", "line_n", F.col(key).isNotNull().cast("long").alias("doc_n"))
    return counted.unionByName(by_doc).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("n", "line_n", "doc_n")))
