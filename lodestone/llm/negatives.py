"""Hard negatives by exact inner products: vectors turned to their principal axes, partial products, and bounds on the rest that discard early."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import from_planes, planes, settled, table

#: Rows of a shard and anchors of a block at most, and bytes of their vectors as doubles; a task holds one of each.
SHARD_ROWS, BLOCK_ROWS, MOST_BYTES = 20_000, 4_000, 1 << 25
#: Rows that the axes are taken from, and their bytes, at most. Every row is searched; axes only decide how early a pair is discarded.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 26
#: Components after which a pair is judged.
STAGES = (8, 16, 32)
#: Candidates that are met at a time, largest norms first: few until there are floors, then twice as many each time.
FIRST_STEP, MOST_STEP = 64, 2048
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EPS = np.finfo(float).eps


def axes(sample: np.ndarray, most: int) -> np.ndarray:
    """The leading principal axes (of the second moments, as products are not centred), one a row."""
    _, turned = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(turned[:, ::-1][:, :most].T)


class Turned:
    """Whole vectors, their leading components, and after each stage a bound on the length of the rest that rounding cannot break."""

    def __init__(self, whole: np.ndarray, lead: np.ndarray, stages: tuple[int, ...]):
        self.whole = whole
        plain = whole.astype(float)
        self.lead = plain @ lead.T
        squared = np.einsum("ij,ij->i", plain, plain)
        slack = 8 * (whole.shape[1] + 8) * EPS
        self.norm = np.sqrt(squared) * (1 + slack)
        past = np.cumsum(self.lead**2, axis=1)
        self.rest = [np.sqrt(np.maximum(0, squared - past[:, s - 1]) + slack * squared) for s in stages]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of rows; where a long cannot hold the sums, by Python integers, cut to a long."""
    if not len(a):
        return np.zeros(0, np.int64)
    most = max(1.0, float(np.abs(a).max())) * max(1.0, float(np.abs(b).max())) * a.shape[1]
    if most < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), LOW), HIGH) for p, q in zip(a, b)], np.int64)


class Best:
    """Of each anchor and slot, the k best (score, place) within the slot's bounds, ties to the smaller place."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # anchors x slots
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none) for _ in range(low.shape[1])]
        self.kth = low.copy()

    def floor(self) -> np.ndarray:
        """The score that a pair must reach to matter to any slot of its anchor."""
        return self.kth.min(axis=1)

    def add(self, anchor: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        for t, held in enumerate(self.held):
            fits = (score >= self.kth[anchor, t]) & (score <= self.high[anchor, t])
            if not fits.any():
                continue
            a, s, p = (np.concatenate((x, y[fits])) for x, y in zip(held, (anchor, score, place)))
            order = np.lexsort((p, ~s, a))  # ~s falls as s rises, without leaving a long
            a, s, p = a[order], s[order], p[order]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            size = np.diff(np.append(first, len(a)))
            nth = np.arange(len(a)) - np.repeat(first, size)
            kept = nth < self.k
            full = nth == self.k - 1
            self.kth[a[full], t] = np.maximum(self.kth[a[full], t], s[full])
            self.held[t] = a[kept], s[kept], p[kept]


def search(queries: Turned, rows: Turned, best: Best, allowed: Callable[[np.ndarray], np.ndarray], places: np.ndarray, stages: tuple[int, ...]) -> int:
    """Adds to best all pairs of a query and a row, named by places, that can matter; allowed says of some rows which queries may meet them.

    After each stage a pair goes on only if its partial product, the product of both rests and a slack for rounding reach the query's floor;
    what is left is verified by integer products. Returns how many pairs were verified.
    """
    verified = 0
    width = queries.whole.shape[1]
    order = np.argsort(-rows.norm, kind="stable")
    at, step = 0, FIRST_STEP
    while at < len(order):
        own = order[at : at + step]
        at, step = at + step, min(2 * step, MOST_STEP)
        floor = best.floor().astype(float)
        slack = 1 + 16 * (width + 8) * EPS * queries.norm[:, None] * rows.norm[own][None, :] + 4 * EPS * np.abs(floor)[:, None]
        near = queries.lead[:, : stages[0]] @ rows.lead[own, : stages[0]].T
        i, j = np.nonzero(allowed(own) & ~(near + queries.rest[0][:, None] * rows.rest[0][own][None, :] + slack < floor[:, None]))
        near, slack = near[i, j], slack[i, j]
        j = own[j]
        for n, (a, b) in enumerate(zip(stages, stages[1:]), 1):
            near = near + np.einsum("ij,ij->i", queries.lead[i, a:b], rows.lead[j, a:b])
            alive = ~(near + queries.rest[n][i] * rows.rest[n][j] + slack < floor[i])  # not a number: goes on
            i, j, near, slack = i[alive], j[alive], near[alive], slack[alive]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            best.add(p, products(queries.whole[p], rows.whole[q]), places[q])
        verified += len(i)
    return verified


PACKED = "rows binary, ids binary, nulls binary, labels binary, kind string, matrix binary, bounds binary"


def _packed(df: DataFrame, key: str, scale: float) -> DataFrame:
    """A row for each (dims, key): its rows by vec_id (null last) and row, with floor(scale * x) of all components in the least type that holds them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        flat = np.floor(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) * scale)
        most = np.abs(flat).max(initial=0)
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        numbers = [group.column(c).to_numpy() for c in ("row", "label")]
        nulls = group.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        bounds = group.column("bounds").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        blobs = [planes(numbers[0]), planes(group.column("vec_id").fill_null(0).to_numpy()), planes(nulls), planes(numbers[1]), kind, zstandard.compress(flat.astype(kind).tobytes(), 1), planes(bounds)]
        columns = [group.column(c)[:1].combine_chunks() for c in ("dims", key)] + [pa.array([x], pa.string() if isinstance(x, str) else pa.binary()) for x in blobs]
        return pa.table(columns, ["dims", key, "rows", "ids", "nulls", "labels", "kind", "matrix", "bounds"])

    return df.groupBy("dims", key).applyInArrow(run, f"dims int, {key} int, {PACKED}")


def _unpacked(row: dict, dims: int) -> tuple[np.ndarray, ...]:
    """rows, ids, nulls, labels, matrix, bounds (a line of two for each slot)."""
    rows, ids, labels = (from_planes(row[c], "<i8") for c in ("rows", "ids", "labels"))
    matrix = np.frombuffer(zstandard.decompress(row["matrix"]), row["kind"]).reshape(len(rows), dims)
    return rows, ids, from_planes(row["nulls"], "?"), labels, matrix, from_planes(row["bounds"], "<i8").reshape(len(rows), -1, 2)


FOUND = "anchor_row long, anchor_id long, slot int, row long, vec_id long, score long"


def _met(shards: DataFrame, blocks: DataFrame, counts: dict[int, tuple[int, int]], leads: dict[int, np.ndarray], stages: tuple[int, ...], k: int, same: bool) -> DataFrame:
    """FOUND: of each anchor and slot the k best rows within each shard, of the anchor's label (but itself) or of all others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            rows, ids, nulls, labels, matrix, _ = _unpacked(left.to_pylist()[0], dims)
            asked, asked_ids, _, asked_labels, asked_matrix, bounds = _unpacked(right.to_pylist()[0], dims)
            lead = leads.get(dims, np.eye(dims)[: stages[-1]])
            steps = tuple(s for s in stages if s < len(lead)) + (len(lead),)
            for label in np.unique(asked_labels):
                mine = np.flatnonzero(asked_labels == label)
                others = np.flatnonzero((labels == label) == same)
                if not len(others):
                    continue
                best = Best(bounds[mine, :, 0].copy(), bounds[mine, :, 1], k)
                of, own = asked[mine], rows[others]
                search(Turned(asked_matrix[mine], lead, steps), Turned(matrix[others], lead, steps), best, lambda at: of[:, None] != own[at][None, :], others, steps)
                for t, (a, s, p) in enumerate(best.held):
                    for column, value in zip(out, (asked[mine][a], asked_ids[mine][a], np.full(len(a), t), rows[p], [None if n else i for i, n in zip(ids[p].tolist(), nulls[p].tolist())], s)):
                        column += list(value)
        return pa.table([pa.array([None if x is None else int(x) for x in c], pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(out)], [c.split()[0] for c in FOUND.split(", ")])

    def over(df: DataFrame, name: str, number: int) -> DataFrame:
        parts = F.create_map(*(F.lit(x) for d, c in counts.items() for x in (d, c[number])))
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("dims")) - 1)))

    left = over(shards, "block", 1)
    right = over(blocks, "shard", 0)
    return left.groupBy("dims", "shard", "block").cogroup(right.groupBy("dims", "shard", "block")).applyInArrow(run, FOUND)


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, stages: tuple[int, ...] = STAGES, sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are its `positives` best other rows of its label; of each,
    the `negatives` best rows of other labels with low * positive_score <= 100 * score <= high * positive_score come back, rank from 1.
    A score is the integer inner product of floor(scale * x); ties go to the smaller vec_id, null last.

    Rows with a null label, or a vector that is null, empty or has components that are null or not finite (scaled, too), take no part. Every other row counts by
    itself, repeats of a vec_id too; a row without vec_id is found but is no anchor. Only vectors of equal length meet. Scores are exact; one
    beyond a long stays at its end and is compared so. Other columns are left out.

    Anchors in blocks meet all rows in shards (see `search`), once for positives and once for negatives.
    """
    fine = f"label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x * {scale}D) < double('Infinity'))"
    columns = (F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = settled(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), *columns).withColumn("dims", F.size("v")))
    asks = F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0)
    per = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(asks).alias("asked")).collect()  # a row for each length of a vector
    room = {r.dims: max(1, MOST_BYTES // (8 * r.dims)) for r in per}
    counts = {r.dims: (math.ceil(r.n / min(shard_rows, room[r.dims])), max(1, math.ceil(r.asked / min(block_rows, room[r.dims])))) for r in per} or {0: (1, 1)}
    drawn = min(sample, SAMPLE_BYTES // (8 * max(counts, default=1) or 1))
    by: dict[int, list] = {}
    for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(drawn).collect():
        by.setdefault(len(r.v), []).append(r.v)
    leads = {d: axes(np.floor(np.array(x) * scale), min(d, stages[-1])) for d, x in by.items()}

    def dealt(seed: int, number: int) -> Column:
        parts = F.create_map(*(F.lit(x) for d, c in counts.items() for x in (d, c[number])))
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.element_at(parts, F.col("dims"))).cast("int")

    shards = settled(_packed(rows.withColumn("shard", dealt(0, 0)).withColumn("bounds", F.array().cast("array<long>")), "shard", scale))
    anchors = rows.where(asks).withColumn("block", dealt(1, 1))
    blocks = settled(_packed(anchors.withColumn("bounds", F.array(F.lit(LOW), F.lit(HIGH))), "block", scale))
    best = Window.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    near = _met(shards, blocks, counts, leads, stages, positives, same=True)
    near = near.withColumn("place", F.row_number().over(best.partitionBy("anchor_row"))).where(F.col("place") <= positives)
    # the scores that a negative of each positive may have: whole numbers, rounded inwards; decimals, as a long may not hold them
    wide = F.col("score").cast("decimal(28,0)")
    least, most = F.ceil(wide * low / 100).cast("decimal(28,0)"), F.floor(wide * high / 100).cast("decimal(28,0)")
    inside = lambda x: F.greatest(F.least(x, F.lit(HIGH).cast("decimal(28,0)")), F.lit(LOW).cast("decimal(28,0)")).cast("long")
    near = settled(near.select("anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), inside(least).alias("least"), inside(most).alias("most")))
    asked = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "least", "most"))).alias("of"))  # at most `positives` each
    bounds = F.flatten(F.transform("of", lambda x: F.array(x["least"], x["most"])))
    padded = F.concat(bounds, F.flatten(F.array_repeat(F.array(F.lit(HIGH), F.lit(LOW)), F.lit(positives) - F.size("of"))))
    again = anchors.join(asked.hint("merge"), F.col("row") == F.col("anchor_row")).withColumn("bounds", padded).drop("of", "anchor_row")
    far = _met(shards, settled(_packed(again, "block", scale)), counts, leads, stages, negatives, same=False)
    far = far.withColumn("rank", F.row_number().over(best.partitionBy("anchor_row", "slot"))).where(F.col("rank") <= negatives).withColumn("place", F.col("slot") + 1)
    named = far.select("anchor_row", "place", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(near.hint("merge"), ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP11_SQL = """
with v as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as anchor_id, q.label = v.label as same, v.n as m, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.n <> v.n and len(q.e) = len(v.e) where q.vec_id % 100 = 0
), p as (
  select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id nulls last, m) as place from s where same
), r as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.n, p.place order by s.score desc, s.vec_id nulls last, s.m) as rank
  from p join s on p.n = s.n and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score where p.place <= 5
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from r where rank <= 5
"""
