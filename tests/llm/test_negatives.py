import math
import random

import duckdb
import numpy as np
import pytest

from lodestone.llm.negatives import OP11_SQL, Best, Turned, axes, mine, op11_negatives, search


def brute(rows, every, k, m):
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for at, (q, a, y) in enumerate(fine):
        if q is None or q % every:
            continue
        scores = sorted((-sum(x * z for x, z in zip(a, b)), i is None, i or 0, n, label == y) for n, (i, b, label) in enumerate(fine) if n != at and len(a) == len(b))
        for p, none, i, _, _ in [s for s in scores if s[4]][:k]:
            found = [s for s in scores if not s[4] and -80 * p <= -100 * s[0] <= -100 * p][:m]
            out += [(q, None if none else i, n + 1, None if other else j, -p, -s) for n, (s, other, j, _, _) in enumerate(found)]
    return sorted(out, key=str)


def vectors(rng, n, dims, labels):
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(3)]
    return [(i, [x + rng.uniform(-0.4, 0.4) for x in centres[i % 3]] if rng.random() < 0.8 else [0.5] * dims, rng.randrange(labels)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("dims,shard,block,stages", [(6, 10_000, 10_000, (8, 16, 32)), (12, 70, 5, (2, 4, 8)), (40, 90, 7, (8, 16, 32))])
def test_matches_brute_force(spark, dims, shard, block, stages):
    rng = random.Random(dims)
    rows = vectors(rng, 300, dims, 3)
    odd = [(1000, None, 1), (1010, [], 1), (1020, [1.0, None] + [0.0] * (dims - 2), 1), (1030, [math.nan] * dims, 1), (1040, [math.inf] * dims, 1), (1050, rows[0][1], None)]
    rows += odd + [(None, rows[1][1], 1), (None, rows[2][1], 2), (10, rows[3][1], 0), (10, rows[3][1], 0), (-20, rows[4][1], 1), (2000, [1.0, 2.0], 1), (2001, [3.0, 4.0], 1), (2002, [2.5, 3.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "'x' as row", "2 as score").repartition(5)
    got = sorted((tuple(r) for r in mine(df, every=10, positives=3, negatives=4, shard_rows=shard, block_rows=block, stages=stages).collect()), key=str)
    assert got == brute(rows, 10, 3, 4)


def test_query_and_sql_agree(spark, tmp_path):
    rng = random.Random(8)
    rows = vectors(rng, 400, 5, 10) + [(7, [0.1] * 5, 4), (500, [0.5] * 5, None), (None, [0.5] * 5, 2), (600, [-0.5] * 5, 3), (700, [0.0] * 5, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((tuple(r) for r in op11_negatives(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(OP11_SQL).fetchall(), key=str) and len(got) > 50
    moved = [(i, [float(np.float32(x)) for x in v], y if i is None or y is None or i % 7 else (y + 1) % 10) for i, v, y in rows]
    assert got == brute(moved, 100, 5, 5)


def test_bounds_discard_early_and_lose_nothing():
    rng = np.random.default_rng(4)
    scale = np.exp(-np.arange(24) / 3)
    a, b = (np.floor(256 * rng.normal(size=(n, 24)) * scale) for n in (20, 4000))
    lead = axes(b, 12)
    assert np.allclose(lead @ lead.T, np.eye(12))
    stages = (3, 6, 12)
    best = Best(np.full((20, 1), -(1 << 63)), np.full((20, 1), (1 << 63) - 1), 5)
    verified = search(Turned(a, lead, stages), Turned(b, lead, stages), best, lambda at: np.ones((20, len(at)), bool), np.arange(4000), stages)
    assert verified < 20 * 4000 / 4
    scores = a @ b.T
    q, s, p = best.held[0]
    for i in range(20):
        order = np.lexsort((np.arange(4000), -scores[i]))[:5]
        assert p[q == i].tolist() == order.tolist() and s[q == i].tolist() == scores[i, order].tolist()


def test_large_values_stay_exact(spark):
    rows = [(i, [1e9 + i / 256, -3e8 * float(i % 7), 7.0], i % 2) for i in range(30)]
    got = sorted((tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA), every=10, scale=1.0).collect()), key=str)
    whole = [(i, [math.floor(x) for x in v], y) for i, v, y in rows]
    want = []
    for q, a, y in whole[::10]:
        s = sorted((-min(sum(x * z for x, z in zip(a, b)), 2**63 - 1), i, label == y) for i, b, label in whole if i != q)
        for p, i, _ in [x for x in s if x[2]][:5]:
            want += [(q, i, n + 1, j, -p, -t) for n, (t, j, _) in enumerate([x for x in s if not x[2] and -80 * p <= -100 * x[0] <= -100 * p][:5])]
    assert got == sorted(want, key=str) and got


def test_empty_table(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).collect() == []
