import math
import random

import duckdb
import pytest

from lodestone.llm.kdtree import OP8_SQL, top_k


def brute(rows, every, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(whole):
        if q is not None and q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for n, (i, b) in enumerate(whole) if n != at and len(a) == len(b))
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(10_000, 10_000), (60, 4)])
def test_matches_brute_force(spark, shard, block):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(-50, 250)]
    rows += [(1000, None), (1010, []), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1030, [math.nan] * 6), (1040, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(2000, [1.0, 2.0]), (2001, [3.0, 4.0]), (10, [9.0] * 6), (3000, rows[7][1]), (3001, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "'x' as v").repartition(5)
    got = sorted((tuple(r) for r in top_k(df, every=10, k=5, shard_rows=shard, block_rows=block).collect()), key=str)
    assert got == brute(rows, 10, 5)


def test_repeated_ids_keep_all_their_rows_as_in_sql(spark):
    rows = [(0, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [3.0, 0.0]), (0, [5.0, 5.0]), (None, [9.0, 0.0]), (50, [0.0, 0.0]), (3, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in top_k(df).collect()), key=str)
    assert got == brute(rows, 50, 5)
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[])")
    db.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(db.execute(OP8_SQL).fetchall(), key=str) == got


def test_most_rows_equal_and_clustered(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-9, 9) for _ in range(4)] for _ in range(12)]
    rows = [(i, [1.0, -1.0, 0.5, 0.25] if i % 3 == 0 else [x + rng.uniform(-0.2, 0.2) for x in centres[i % 12]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = sorted((tuple(r) for r in top_k(df, shard_rows=40, block_rows=3).collect()), key=str)
    assert got == brute(rows, 50, 5)


def test_large_values_stay_exact(spark):
    rows = [(i, [1e9 + i / 256, -3e8 * float(i), 7.0]) for i in range(20)]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, scale=1.0).collect()}
    want = set()
    whole = {i: [math.floor(x) for x in v] for i, v in rows}
    for q in (0, 10):
        s = sorted((-max(min(sum(x * y for x, y in zip(whole[q], b)), 2**63 - 1), -(2**63)), i) for i, b in whole.items() if i != q)
        want |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:5])}
    assert {(q, s) for q, _, _, s in got} == {(q, s) for q, _, _, s in want}


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
