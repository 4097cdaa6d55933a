"""Ordered operators whose groups are dealt over several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, ordered


@pytest.fixture
def split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def hot_rows(rng):
    return [("hot" if i % 3 else rng.choice("ab"), rng.randrange(500), i) for i in range(900)] + [(None, 5, 900), (None, 400, 901)]


def test_islands_and_growth(split):
    rows = hot_rows(random.Random(1))
    df = split.createDataFrame(rows, "g string, at long, id long").repartition(3)
    cut = ordered.ranges(df, ["g", "at"])
    assert cut.where("g = 'hot'").select("_part").distinct().count() > 1  # else the test says nothing
    want = []
    for own in groups_of(rows).values():
        last, island = None, 0
        for g, at, i in sorted(own, key=lambda r: r[1:]):
            island += last is None or at - last > 3
            want.append((i, island))
            last = at
    got = [(r.id, r.island) for r in ordered.islands(df, "g", "at", 3).collect()]
    assert sorted(got) == sorted(want)
    values = [(g, at, i, None if i % 17 == 0 else (i * 7) % 101) for g, at, i in rows]
    grown = []
    for own in groups_of(values).values():
        last = None
        for n, (_, _, i, v) in enumerate(sorted(own, key=lambda r: (r[1], r[2]))):
            grown.append((i, v - last if n and None not in (v, last) and v >= last else None))
            last = v
    got = ordered.difference(split.createDataFrame(values, "g string, at long, id long, v long").repartition(3), "g", ["at", "id"], "v").collect()
    assert sorted((r.id, r.delta) for r in got) == sorted(grown)


def test_intervals_of_a_hot_group(split):
    rng = random.Random(2)
    rows = [(g, at * 3, at * 3 + rng.randrange(0, 12)) for g, at, _ in hot_rows(rng) if g]
    df = split.createDataFrame(rows, "g string, start long, end long").repartition(3)
    merged, most = [], {}
    for g, own in groups_of(rows).items():
        for _, a, b in sorted(own):
            if merged and merged[-1][0] == g and a <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
                merged[-1][3] += 1
            else:
                merged.append([g, a, b, 1])
        points = sorted({x for _, a, b in own for x in (a, b)})
        most[g] = max(sum(a <= p < b for _, a, b in own) for p in points)
    assert sorted(map(list, intervals.coalesced(df, "g").collect())) == sorted(merged)
    assert dict(intervals.depth(df, "g").collect()) == most


def test_order_of_members_of_a_hot_group(split):
    base = [("x", i, i) for i in range(400)] + [("y", i, i) for i in range(300)]
    target = [("x", i, i * 2) for i in range(5, 400)] + [("y", i, i if i != 150 else 900) for i in range(300)]
    frames = (split.createDataFrame(rows, "g string, m long, at long") for rows in (base, target))
    got = {r.g: (r.common, r.reordered) for r in ordered.reordered(*frames, "g", "m", "at").collect()}
    assert got == {"x": (395, False), "y": (300, True)}


def test_empty_tables(split):
    none = split.createDataFrame([], "g string, at long, id long, start long, end long")
    assert ordered.islands(none, "g", "at", 1).count() == ordered.difference(none, "g", ["at"], "id").count() == 0
    assert intervals.coalesced(none, "g").count() == intervals.depth(none, "g").count() == 0


def test_reread_in_dense_bins(spark):
    pick = random.Random(5)
    rows = [(i % 2, i, pick.randrange(200), pick.choice([0, 1, 3, 40, 900])) for i in range(160)] + [(0, 200, 50, 0), (1, 201, 100, 0)]
    rows = [(g, i, s, s + n) for g, i, s, n in rows] + [(0, 300, 5, None), (0, 301, None, 9)]
    df = spark.createDataFrame(rows, "g int, id int, start int, end int").withColumn("seq", F.hash("id") % 50)
    seq = {r.id: r.seq for r in df.collect()}
    full = [r for r in rows if None not in r]
    want = {(g, i) for g, i, s, e in full for h, j, t, f in full if g == h and seq[j] < seq[i] and t < e and s < f}
    for width in (7, 50, 1000):
        assert {(r.g, r.id) for r in intervals.reread(df, "g", "seq", width).collect()} == want


def test_places_of_groups_over_several_ranges_join_a_row_a_range(split):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(300)] + [(f"g{i}", j) for i in range(200) for j in range(3)]
    random.Random(1).shuffle(rows)
    df = split.createDataFrame(rows, "g string, at int")
    placed = ordered.placed(df, ["g"], ["at"])
    assert all(r.place == r.at + 1 for r in placed.collect()) and placed.count() == len(rows)
    assert "broadcast" in placed._jdf.queryExecution().optimizedPlan().toString()
