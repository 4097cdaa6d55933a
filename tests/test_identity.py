import random
from decimal import Decimal

from pyspark.sql import functions as F

from lodestone.operators import identity

EVENT = "run string, event string, at int, kind string, status string, usage string, charge string, request string, item string, tokens int, cost string"


def made(run, event, at, kind, status=None, usage=None, charge=None, request=None, item=None, tokens=None, cost=None):
    return (run, event, at, kind, status, usage, charge, request, item, tokens, cost)


KEYS = [["usage"], ["charge"], ["request", "item"]]
PAYLOAD = ["kind", "status", "usage", "charge", "request", "item", "tokens", "cost"]


def test_figures_worked_out_by_hand(spark):
    """Three runs of four planned: one read and one usage record sent twice, a charge sent twice."""
    rows = [made(r, f"s-{r}", 0, "run_started") for r in ("r1", "r2", "r3")]
    rows += [made(r, f"f-{r}", 99, "run_finished", s) for r, s in (("r1", "succeeded"), ("r2", "timeout"), ("r3", "succeeded"))]
    contexts = [("r1", "e-read-1", 100), ("r1", "e-grep-1", 50), ("r1", "e-read-2", 40), ("r1", "e-lsp-1", 60), ("r2", "e-read-3", 30), ("r3", "e-read-4", 80)]
    rows += [made(r, e, 10 + n, "context", request=f"q-{r}", item=e, tokens=t) for n, (r, e, t) in enumerate(contexts)]
    rows += [rows[6], made("r1", "again", 50, "context", request="q-r1", item="e-read-1", tokens=100)]
    rows += [made("r1", "u-1", 60, "usage", usage="u1", tokens=800, cost="2.40"), made("r1", "u-1b", 61, "usage", usage="u1", tokens=800, cost="2.40"), made("r2", "u-2", 60, "usage", usage="u2", tokens=320, cost="0.68"), made("r3", "u-3", 60, "usage", usage="u3", tokens=400, cost="1.07")]
    rows += [made("r1", "c-1", 70, "setup", charge="c1", cost="0.05"), made("r1", "c-2", 71, "setup", charge="c1", cost="0.05"), made("r4", "plan", 0, "planned")]
    found = identity.identified(spark.createDataFrame(rows, EVENT).repartition(4), "run", "event", "at", PAYLOAD, KEYS).cache()
    told = {r.run: r for r in identity.runs(found, "run", "kind", "status").collect()}
    assert {k: r.status for k, r in told.items()} == {"r1": "succeeded", "r2": "timeout", "r3": "succeeded", "r4": "not_started"}
    assert sum(r.attempted for r in told.values()) == 3 and sum(r.duplicates for r in told.values()) == 1 and sum(r.conflicts for r in told.values()) == 0
    counted = found.where("counted")
    context = counted.where("kind = 'context'").agg(F.sum("tokens"), F.sum(F.when(~F.col("item").startswith("e-lsp"), F.col("tokens")))).first()
    assert tuple(context) == (360, 300)
    assert counted.where("kind = 'usage'").agg(F.sum("tokens")).first()[0] == 1100 + 320 + 100
    assert counted.where("kind in ('usage', 'setup')").agg(F.sum(F.col("cost").cast("decimal(10,2)"))).first()[0] == Decimal("4.20") 


def plain(rows):
    first, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], str(r))):
        if r[0] is not None and r[1] is not None:
            first.setdefault((r[0], r[1]), r)
    parent = {k: k for k in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        for key in ((5,), (6,), (7, 8)):
            if r[0] is None or r[1] is None or any(r[c] is None for c in key):
                continue
            a, b = root((r[0], r[1])), root(groups.setdefault((r[0], key, *(r[c] for c in key)), (r[0], r[1])))
            low, high = sorted((a, b), key=lambda k: (first[k][2], k[1]))
            parent[high] = low
    return {k: root(k)[1] for k in first}


def test_chains_of_keys_match_a_plain_union(spark):
    rng = random.Random(8)
    some = lambda p, n: str(rng.randrange(n)) if rng.random() < p else None
    rows = [made(rng.choice(["r1", "r2", "hot", None] + ["hot"] * 4), rng.choice([f"e{i}", f"e{i % 40}", None]), i, "x", usage=some(0.3, 60), charge=some(0.2, 60), request=some(0.5, 9), item=some(0.5, 9), tokens=i % 2) for i in range(300)]
    found = identity.identified(spark.createDataFrame(rows, EVENT).repartition(4), "run", "event", "at", PAYLOAD, KEYS).collect()
    want = plain(rows)
    named = [r for r in found if r.run is not None and r.event is not None]
    assert len(found) == 300 and all(r.group == want[r.run, r.event] for r in named)
    assert all(r.counted for r in found if r.run is None or r.event is None)
    assert sum(r.counted for r in named) == len({(run, e) for (run, _), e in want.items()})
    for r in named:
        twins = [x for x in rows if x[:2] == (r.run, r.event)]
        assert r.same == len(twins) and r.conflict == (len({x[3:] for x in twins}) > 1)


def test_invalid_runs_and_no_events(spark):
    rows = [made("a", "1", 0, "run_started"), made("b", "1", 0, "run_started"), made("b", "2", 1, "run_finished", "succeeded"), made("b", "2", 2, "run_finished", "timeout"), made("c", "1", 0, "run_started"), made("c", "2", 1, "run_finished", "succeeded"), made("c", "2", 1, "run_finished", "succeeded")]
    found = identity.identified(spark.createDataFrame(rows, EVENT), "run", "event", "at", PAYLOAD, KEYS)
    assert {r.run: (r.status, r.duplicates, r.conflicts) for r in identity.runs(found, "run", "kind", "status").collect()} == {"a": ("invalid", 0, 0), "b": ("invalid", 0, 1), "c": ("succeeded", 1, 0)}
    none = identity.identified(spark.createDataFrame([], EVENT), "run", "event", "at", PAYLOAD, KEYS)
    assert none.collect() == identity.runs(none, "run", "kind", "status").collect() == []
