import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, intervals, metrics, ordered, reconcile, search, sweep, textdiff, validate


def test_cursors():
    mark = search.fingerprint(name=" x ", kind=None)
    assert mark == search.fingerprint(name="x") != search.fingerprint(name="y")
    token = search.encode_cursor("gen_1", mark, 20)
    assert search.decode_cursor(token, "gen_1", mark, 20) == 20
    for args, code in ((("gen_2", mark), "CURSOR_EXPIRED"), (("gen_1", "other"), "CURSOR_INVALID"), (("gen_1", mark, 19), "CURSOR_INVALID")):
        with pytest.raises(search.CursorError) as e:
            search.decode_cursor(token, *args)
        assert e.value.code == code
    with pytest.raises(search.CursorError):
        search.decode_cursor("%%%", "gen_1", mark)


def test_pages_meet_end_to_end(spark):
    df = spark.createDataFrame([(i % 4 or None, i) for i in range(30)] + [(2, None), (None, None)], "a int, b int")
    keys = [("a", True), ("b", False)]
    whole = [tuple(r) for r in df.orderBy(F.desc("a"), F.asc("b")).collect()]
    seen, last = [], None
    while True:
        rows = search.page_after(df, keys, last, 7) if last else search.page(df, [F.desc("a"), F.asc("b")], 7)
        part = [tuple(r) for r in rows.collect()]
        if not part:
            break
        seen += part
        last = part[-1]
    assert seen == whole


def test_only_given_conditions_count(spark):
    df = spark.createDataFrame([("A", ["x\\y"]), ("b", ["z"])], "k string, p array<string>")
    assert search.where_given(df, same={"k": "a"}, path=("p", "x/y")).count() == 1
    assert search.where_given(df, equal={"k": None}, path=("p", "")).count() == 2


def test_reconcile_with_moves_and_nulls(spark):
    base = spark.createDataFrame([("First", "h1"), ("Second", "h2"), ("Stable", "h3"), ("Null", None)], "path string, h string")
    target = spark.createDataFrame([("Renamed", "h1"), ("Second", "h9"), ("Stable", "h3"), ("Missed", "h4"), ("Null", None)], "path string, h string")
    changed = reconcile.changes(base, target, "path", "h")
    assert {(r.path, r.change) for r in changed.collect()} == {("First", "deleted"), ("Renamed", "added"), ("Second", "modified"), ("Missed", "added")}
    assert [tuple(r) for r in reconcile.moves(changed, "path").collect()] == [("h1", "First", "Renamed")]
    hints = spark.createDataFrame([("Second",)], "path string")
    assert {r.path for r in reconcile.unreported(changed, hints, "path").collect()} == {"First", "Renamed", "Missed"}
    assert reconcile.unreported(changed, hints.limit(0), "path").count() == 0


def test_diff_stages(spark):
    schema = "id string, name string, signature string, body string, shape string"
    base = spark.createDataFrame([("a", "A", "int", "x", "1"), ("b", "B", "int", "y z", "2"), ("c", "C", "int", "q", "3"), ("d", "D", "int", "r", "4"), ("e", "E", "s", "t", "5"), ("f", "F", "s", "u", "6")], schema)
    target = spark.createDataFrame([("a", "A", "int", "X", "1"), ("b", "B", "int", "y  z", "2"), ("c", "C", "str", "changed", "3"), ("d2", "D", "str", "r", "4"), ("e2", "E2", "s", "t", "5"), ("g", "G", "s", "v", "7")], schema)
    got = {(r.kind, r.base_id, r.target_id, r.confidence) for r in reconcile.snapshot_diff(base, target).collect()}
    assert got == {
        ("body_changed", "a", "a", 1.0), ("formatting_only", "b", "b", 1.0), ("signature_changed", "c", "c", 1.0), ("signature_changed", "d", "d2", 0.9),
        ("rename_candidate", "e", "e2", 0.5), ("deleted", "f", None, 1.0), ("added", None, "g", 1.0),
    }


def test_intervals_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, i, s, s + rng.randrange(1, 400)) for g in range(3) for i in range(25) for s in [rng.randrange(500)]]
    df = spark.createDataFrame(rows, "g int, id int, start long, end long")
    got = {(r.g, r.left_id, r.right_id) for r in sweep.overlaps(df, df, "g", rows=9).collect()}
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    inside = {}
    for a in rows:
        held = [(b[3] - b[2], b[2], b[1]) for b in rows if b[0] == a[0] and b[2] <= a[2] and a[3] <= b[3] and b[1] > a[1]]
        if held:
            inside[a[0], a[1]] = min(held)[2]
    assert {(r.g, r.inner_id): r.outer_id for r in sweep.enclosing(df, df, "g", later=True, rows=9).collect()} == inside
    depth = {r.g: r.most_open for r in intervals.depth(df, "g").collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        assert depth[g] == max(sum(r[2] <= t < r[3] for r in own) for t in range(1000))
        cover = {t for r in own for t in range(r[2], r[3])}
        assert sum(r.end - r.start for r in intervals.coalesced(df.where(F.col("g") == g), "g").collect()) == len(cover)


def test_running_budget_stays_exhausted(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, n long").repartition(7)
    total = 0
    want = set()
    for i, n in rows:
        total += n
        want.add((i, n, total, total <= 300, total - n > 300))
    assert {tuple(r) for r in ordered.within_budget(df, ["i"], "n", 300).collect()} == want


def test_impact_ends_on_cycles_and_says_what_lies_beyond(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    found, beyond = graph.impact(edges, root, 1)
    assert {tuple(r) for r in found.collect()} == {("a", "b", 0), ("b", "c", 1)} and beyond
    found, beyond = graph.impact(edges, root, 10)
    assert {tuple(r) for r in found.collect()} == {("a", "b", 0), ("b", "c", 1), ("c", "a", 2), ("c", "d", 2), ("d", "e", 3)} and not beyond
    none, beyond = graph.impact(edges, spark.createDataFrame([("zz",)], "node string"), 3)
    assert none.count() == 0 and not beyond
    up = graph.ancestors(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")))
    assert {r.ancestor for r in up.where("node = 'e'").collect()} == {"a", "b", "c", "d"}


def test_telemetry_figures(spark):
    df = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 3.0), ("r", 10.0), ("q", None)], "k string, v double")
    got = {r.k: (r.n, r.median, r.p95, r.most) for r in metrics.latency(df, "k", "v").collect()}
    assert got == {"r": (4, 2.5, 10.0, 10.0), "q": (0, None, None, None)}
    parts = spark.createDataFrame([("x", '{"a": 1, "b": 2}'), ("x", '{"a": 5}'), ("x", None), ("x", '{"a": "no"}')], "k string, j string")
    assert {(r.key, r.total, r.n) for r in metrics.map_sum(parts, ["k"], "j").collect()} == {("a", 6, 3), ("b", 2, 1)}
    cache = spark.createDataFrame([(i, i, 10) for i in range(10)], "k int, age int, size long")
    gone = metrics.evict(cache, "age", "size", "k", 65, cache.where("k = 1"))
    assert sorted(r.k for r in gone.collect()) == [0, 2, 3, 4]


def test_violations(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    rules = {"positive": F.col("v") > 0, "small": F.col("v") < 5}
    assert {tuple(r) for r in validate.violations(df, "k", rules).collect()} == {("small", 1), ("positive", 2), ("small", 2), ("positive", 3)}
    assert validate.asserted(df.where("k = 3"), {"small": rules["small"]}).count() == 1
    with pytest.raises(Exception):
        validate.asserted(df, rules).collect()


def apply_hunks(a, found):
    out, at = [], 0
    for h in found:
        head, *body = h.split("\n")
        start, n = (int(x) for x in head.split(" ")[1][1:].split(","))
        first = start - 1 if n else start
        out += a[at:first]
        at = first
        for line in body:
            if line[0] == "+":
                out.append(line[1:])
            else:
                assert a[at] == line[1:]
                at += 1
                if line[0] == " ":
                    out.append(line[1:])
    return out + a[at:]


@pytest.mark.parametrize("seed", range(60))
def test_hunks_turn_one_text_into_the_other(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcde") for _ in range(rng.randrange(25))]
    b = [rng.choice("abcde") for _ in range(rng.randrange(25))] if seed % 3 else [x for x in a if rng.random() > 0.2] + ["z"] * (seed % 2)
    same = textdiff.edits(a, b)
    assert all(a[i] == b[j] for i, j in same) and same == sorted(set(same))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert len(same) == table[-1][-1]
    assert apply_hunks(a, textdiff.hunks(a, b, same, context=seed % 4)) == b


def test_line_diffs_under_budgets(spark):
    rows = [(1, "a\nb\nc", "a\nB\nc"), (2, None, "x\ny"), (3, "x", None), (4, "a\nb", "c\nd"), (5, "\n".join(map(str, range(400))), "\n".join(str(-i) for i in range(400))), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, base string, target string")
    got = {r.k: r for r in textdiff.line_diffs(df, "k", most_bytes=1000, most_edits=500).collect()}
    assert got[1].hunks == ["@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"] and (got[1].removed, got[1].added, got[1].truncated) == (1, 1, False)
    assert (got[2].mode, got[2].added, got[3].removed) == ("header_only", 2, 1)
    assert got[5].mode == "fingerprint_only" and got[5].truncated
    assert got[6].hunks == [] and (got[1].omitted, got[2].omitted, got[5].omitted) == (0, 1, 800)


def test_a_hunk_past_the_budget_is_cut_to_what_fits(spark):
    base = "\n".join(f"line {i}" for i in range(60))
    target = base.replace("line 3\n", "LINE 3\n").replace("\n".join(f"line {i}" for i in range(20, 40)), "\n".join(f"other {i}" for i in range(20, 40)))
    df = spark.createDataFrame([(1, base, target)], "k int, base string, target string")
    for most in (40, 60, 120, 200, 400, 4000):
        r = textdiff.line_diffs(df, "k", most_bytes=most).first()
        shown = sum(x[:1] in "+-" for h in r.hunks for x in h.split("\n")[1:])
        assert sum(len(h.encode()) for h in r.hunks) <= most and shown + r.omitted == 42 and r.truncated == (r.omitted > 0)
        for h in r.hunks:
            head, *body = h.split("\n")
            old, new = (sum(x[:1] != s for x in body) for s in "+-")
            assert f",{old} +" in head and head.endswith(f",{new} @@")
    assert r.omitted == 0 and len(r.hunks) == 2


def test_residual_text_ignores_spans_and_space(spark):
    df = spark.createDataFrame([(1, "ab cd ef"), (2, "ab XX  ef")], "k int, t string")
    spans = spark.createDataFrame([(1, 3, 5), (2, 3, 5), (2, 4, 6)], "k int, start long, end long")
    rest = {r.k: r.rest for r in textdiff.residual(df, "k", "t", spans).collect()}
    assert rest[1] == rest[2]


def test_words_are_counted_by_chunk_unless_keys_come_again(spark):
    from lodestone.operators import metrics

    rows = [(1, "a b a\nb"), (1, "c a\r\nx\ra"), (2, "a\n\na c"), (None, "a"), (None, "b"), (3, ""), (4, None), (5, "c-c_a")]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    docs = spark.createDataFrame(rows, "k long, t string").repartition(3)
    got = metrics.word_counts(docs, "k", "t", names)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 8, 6, 3), ("b", 3, 3, 1), ("c", 4, 3, 3)]
    counted = metrics.word_counts(docs.where("k > 1"), "k", "t", names)
    assert sorted(tuple(r) for r in counted.collect()) == [("a", 3, 3, 2), ("c", 3, 2, 2)]


def test_line_diffs_of_several_slices(spark):
    from lodestone.operators import textdiff

    pairs = spark.range(700, numPartitions=1).selectExpr("id", "repeat(concat(id, ' text\n'), 3) as base", "concat(repeat(concat(id, ' text\n'), 3), 'more') as target")
    got = textdiff.line_diffs(pairs, "id").collect()
    assert {r.id for r in got} == set(range(700)) and all((r.mode, r.removed, r.added, r.omitted) == ("line_hunks", 1, 1, 0) for r in got)
