"""Exact top-k by inner product: a KD-tree per shard, searched best-first under box bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import settled, slices, table

LEAF = 256
#: Vectors of a shard and queries of a block; a task holds one of each.
SHARD_ROWS = 20_000
BLOCK_ROWS = 10_000
#: Rows that the regions' splits are taken from, and regions, at most. Every row is indexed; what lies in a region only decides what must be searched.
SAMPLE, REGIONS = 20_000, 4096
LONG = (-(1 << 63), (1 << 63) - 1)


class Tree:
    """Median splits on the widest dimension; each node has the tight box of its rows, each leaf a slice of `order`."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        low, high, child = [], [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = rows[self.order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            child.append([a, b, 0])
            here = len(child) - 1
            if parent >= 0:
                child[parent][side] = here
            spread = high[-1] - low[-1]
            if b - a > leaf and spread.max() > 0:
                mid = (a + b) // 2
                column = own[:, int(np.argmax(spread))]
                split = np.argpartition(column, mid - a) if rows.dtype != object else np.argsort(column, kind="stable")
                self.order[a:b] = self.order[a:b][split]
                child[here] = [0, 0, 1]
                todo += [(a, mid, here, 0), (mid, b, here, 1)]
        self.low, self.high, self.child = np.stack(low), np.stack(high), child
        self.rows = rows[self.order]


def search(tree: Tree, query: np.ndarray, own: int, k: int, floor: float, bounds: np.ndarray) -> list[tuple[int, int]]:
    """The k best (score, row) of rows other than own, ties to the smaller row; scores below floor may be left out.

    Nodes come best bound first; the walk ends once no box can reach the k-th score so far or the floor.
    """
    best: list[tuple] = []  # a heap of (score, -row): its head is the worst that is kept
    todo = [(-bounds[0], 0)]
    while todo:
        bound, node = heapq.heappop(todo)
        kth = max(floor, best[0][0]) if len(best) == k else floor
        if -bound < kth:
            break
        a, b, split = tree.child[node]
        if split:
            for x in (a, b):
                if bounds[x] >= kth:
                    heapq.heappush(todo, (-bounds[x], x))
            continue
        scores = tree.rows[a:b] @ query
        for i in np.flatnonzero(scores >= kth):
            one = (scores[i], -int(tree.order[a + i]))
            if -one[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, one)
            elif one > best[0]:
                heapq.heapreplace(best, one)
    return [(int(s), -i) for s, i in best]


class Regions:
    """Parts of space by median splits of a sample, numbered over all vector lengths that the sample has; -1 is for other lengths."""

    def __init__(self, sample: list[list[float]], number: int):
        by: dict[int, list] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        self.trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.size = 0
        for dims, rows in sorted(by.items()):
            dim, at, child = [], [], []
            todo = [(np.array(rows), max(1, round(number * len(rows) / len(sample))), -1, 0)]
            while todo:
                own, parts, parent, side = todo.pop()
                here = len(dim)
                if parent >= 0:
                    child[parent][side] = here
                spread = own.max(0) - own.min(0)
                widest = int(np.argmax(spread))
                column = np.sort(own[:, widest])
                cut = column[len(column) // 2]
                if cut == column[0]:  # over half are the least: these stay together
                    cut = column[np.searchsorted(column, cut, "right")] if column[-1] > cut else cut
                if parts < 2 or not spread[widest] > 0:
                    dim.append(-1), at.append(self.size), child.append([0, 0])
                    self.size += 1
                    continue
                high = own[:, widest] >= cut
                dim.append(widest), at.append(cut), child.append([0, 0])
                todo += [(own[~high], parts // 2, here, 0), (own[high], parts - parts // 2, here, 1)]
            self.trees[dims] = np.array(dim), np.array(at), np.array(child)

    def of(self, rows: np.ndarray) -> np.ndarray:
        if rows.shape[1] not in self.trees:
            return np.full(len(rows), -1)
        dim, at, child = self.trees[rows.shape[1]]
        node = np.zeros(len(rows), np.int64)
        while (inner := np.flatnonzero(dim[node] >= 0)).size:
            n = node[inner]
            node[inner] = child[n, (rows[inner, dim[n]] >= at[n]).astype(int)]
        return at[node].astype(np.int64)


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n))


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x), as whole doubles."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).reshape(len(column), -1)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k highest integer inner products with other rows.

    Components are taken as floor(scale * x). Ties go to the smaller vec_id, null last; fewer other rows than k: all of them.
    Rows whose vector is null, empty or has null or non-finite components take no part. Every other row counts by itself: rows that
    repeat a vec_id are found, and ask, each for its own; a row without vec_id is found but doesn't ask. Only vectors of equal length meet.
    Sums are exact (Python integers where doubles would not be); a score beyond a long stays at its end.

    Space is cut by median splits of a sample of at most SAMPLE rows into at most REGIONS regions with tight boxes of all their rows; a region's rows are
    dealt by hash into shards of fixed size, its queries into blocks. A query first searches one shard of its own region; with the k-th
    score found there it is then sent only to the regions whose box can reach that score, where the trees go on with it.
    """
    fine = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    good = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    n = good.count()
    drawn = good.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    regions = Regions([r.v for r in drawn], min(REGIONS, math.ceil(n / shard_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                region = np.full(part.num_rows, -1, np.int32)
                for at, matrix in _by_length(part.column(2)):
                    region[at] = regions.of(matrix)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region)], ["row", "vec_id", "v", "region"])

    numbered = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    rows = settled(numbered.mapInArrow(place, "row long, vec_id long, v array<double>, region int"))
    asks = (F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, 4096):
                region, asking = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                for at, matrix in _by_length(part.column(1)):
                    matrix = np.floor(matrix * scale)
                    for r in np.unique(region[at]):
                        own = region[at] == r
                        low, high = (matrix[own].min(0), matrix[own].max(0)) if r >= 0 else (matrix[0, :0], matrix[0, :0])
                        was = held.get(r, [low, high, 0, 0])
                        held[r] = [np.minimum(was[0], low), np.maximum(was[1], high), was[2] + int(own.sum()), was[3] + int(asking[at][own].sum())]
        if held:
            yield pa.RecordBatch.from_pylist([{"region": int(r), "low": x[0].tolist(), "high": x[1].tolist(), "n": x[2], "asked": x[3]} for r, x in held.items()], boxed)

    def whole(group: pa.Table) -> pa.Table:
        low, high = (np.array(f(group.column(c).to_pylist(), axis=0)).tolist() for f, c in ((np.min, "low"), (np.max, "high")))
        return pa.Table.from_pylist([{"region": group.column("region")[0].as_py(), "low": low, "high": high, "n": sum(group.column("n").to_pylist()), "asked": sum(group.column("asked").to_pylist())}], boxed)

    boxed = pa.schema([("region", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("n", pa.int64()), ("asked", pa.int64())])
    kinds = "region int, low array<double>, high array<double>, n long, asked long"
    boxes = rows.select("region", "v", asks.alias("asks")).mapInArrow(bound, kinds).groupBy("region").applyInArrow(whole, kinds).collect()  # at most REGIONS rows
    shards = {r.region: math.ceil(r.n / shard_rows) for r in boxes}
    by: dict[int, tuple] = {}
    for dims in {len(r.low) for r in boxes} - {0}:
        own = [r for r in boxes if len(r.low) == dims]
        by[dims] = np.array([r.region for r in own]), np.array([r.low for r in own]), np.array([r.high for r in own])

    def to_region(of: dict[int, int], name: str) -> DataFrame:
        return F.broadcast(rows.sparkSession.createDataFrame(list(of.items()) or [(-2, 0)], f"region int, {name} int"))  # at most REGIONS + 1 rows

    def dealt(seed: int, among: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(among)).cast("int")

    schema = "query_row long, query_id long, row long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last: a row's place is its rank among ties
            v, q = _matrix(left.column("v"), scale), _matrix(right.column("q_v"), scale)
            if max(np.abs(v).max(), 1) * max(np.abs(q).max(), 1) * v.shape[1] >= 2**53:
                v, q = (np.array([[int(x) for x in r] for r in m], dtype=object) for m in (v, q))
            ids, number = left.column("vec_id").to_pylist(), left.column("row").to_pylist()
            place = {x: i for i, x in enumerate(number)}
            tree = Tree(v)
            zero = np.zeros_like(q)
            bounds = np.maximum(q, zero) @ tree.high.T + np.minimum(q, zero) @ tree.low.T
            floors, names = right.column("q_floor").to_pylist(), right.column("q_vec_id").to_pylist()
            for i, row in enumerate(right.column("q_row").to_pylist()):
                floor = -math.inf if floors[i] is None else floors[i]
                out += ((row, names[i], number[x], ids[x], min(max(s, LONG[0]), LONG[1])) for s, x in search(tree, q[i], place.get(row, -1), k, floor, bounds[i]))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], [], [], []))], ["query_row", "query_id", "row", "vec_id", "score"])

    def against(asking: DataFrame, blocks: dict[int, int]) -> DataFrame:
        """The best of each query (row, vec_id, v, floor, region, shard) in that shard."""
        block = to_region(blocks, "blocks")
        left = rows.join(to_region(shards, "shards"), "region").withColumn("shard", dealt(0, "shards")).join(block, "region").where("blocks > 0")
        left = left.select("row", "vec_id", "v", F.size("v").alias("dims"), "region", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = asking.join(block, "region").withColumn("block", dealt(1, "blocks")).withColumn("dims", F.size("v"))
        right = right.select(*(F.col(c).alias(f"q_{c}") for c in ("row", "vec_id", "v", "floor", "dims", "region", "shard", "block")))
        return left.groupBy("dims", "region", "shard", "block").cogroup(right.groupBy("q_dims", "q_region", "q_shard", "q_block")).applyInArrow(meet, schema)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of queries in their batch, and the regions whose box can reach their floor."""
        for batch in batches:
            for part in slices(batch, 1024):
                floors = part.column(4).to_numpy(zero_copy_only=False)
                for at, matrix in _by_length(part.column(2)):
                    q = np.floor(matrix * scale)
                    names, low, high = by.get(q.shape[1], (np.array([-1]), np.zeros((1, q.shape[1])), np.zeros((1, q.shape[1]))))
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    most = up @ high.T + down @ low.T
                    slack = 1 + 1e-9 * (up @ np.abs(high).T - down @ np.abs(low).T)  # sums of doubles are not exact
                    i, j = np.nonzero((names == -1) | np.isnan(floors[at])[:, None] | ~(most + slack < floors[at][:, None]))
                    kept = part.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names[j].astype(np.int32))], ["row", "vec_id", "v", "home", "floor", "region"])

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    queries = rows.where(asks).join(to_region(shards, "shards"), "region").withColumn("shard", dealt(0, "shards")).drop("shards")
    home = settled(against(queries.withColumn("floor", F.lit(None).cast("long")), {r.region: math.ceil(r.asked / block_rows) for r in boxes}))
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    asking = settled(queries.join(kth.hint("merge"), "row", "left").select("row", "vec_id", "v", F.struct("region", "shard").alias("home"), "floor"))
    sent = asking.mapInArrow(reach, "row long, vec_id long, v array<double>, home struct<region: int, shard: int>, floor long, region int")
    blocks = {r.region: math.ceil(r["count"] / block_rows) for r in sent.groupBy("region").count().collect()}  # at most REGIONS + 1 rows
    sent = sent.join(to_region(shards, "shards"), "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    found = home.union(against(sent.where("not (home.region = region and home.shard = shard)"), blocks))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.n <> v.n and len(q.e) = len(v.e) where q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by n order by score desc, vec_id nulls last) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
