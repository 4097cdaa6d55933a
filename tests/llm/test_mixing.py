import itertools
import random
from collections import defaultdict

from lodestone.llm.mixing import exact_fill, mix, quotas


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "zz", None, "é", "tiny"])
        n = rng.randrange(2) if source == "tiny" else rng.choice([0, 1, 7, 40, rng.randrange(300)])
        rows.append((i, " \t".join(["w"] * n) if n or i % 2 else None, source))
    rows += [(5, "same text", "a")] * 3 + [(None, "no id", "b"), (None, None, None), (9001, "long " * 5000, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as key", "3 as h").repartition(6)
    out = mix(docs).collect()
    assert len(out) == len(rows)
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6
        assert abs(taken[s] - targets[s]) <= 1, s
    assert all(r.source_size == sizes[r.source] for r in out)
    again = mix(docs.repartition(3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_exact_fill_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 30), 4))
        counts = [rng.randrange(1, 4) for _ in sizes]
        budget = rng.randrange(1, 120)
        best = max(
            s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(sizes, c))) <= budget
        )
        got = exact_fill(sizes, counts, budget)
        assert sum(s * q for s, q in got.items()) == best
        assert all(q <= counts[sizes.index(s)] for s, q in got.items())


def test_quotas_stay_within_counts():
    rng = random.Random(5)
    for _ in range(40):
        sizes = sorted(rng.sample(range(1, 5000), 200))
        counts = [rng.randrange(1, 900) for _ in sizes]
        budget = rng.randrange(sum(s * c for s, c in zip(sizes, counts)))
        got = quotas(sizes, counts, budget, exact=4096)
        assert all(0 <= got[s] <= c for s, c in zip(sizes, counts))
        assert abs(budget - sum(s * q for s, q in got.items())) <= 1


def test_edges(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
