import hashlib
import random
import time

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import merkle, scopes
from lodestone.sources.sections import headings


def test_chains_of_headings(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["#" * rng.randint(1, 7) + f" n{i}", "plain", ""]) for i in range(60)) for _ in range(6)] + [None, "", "# one"]
    want = set()
    for path, text in enumerate(texts):
        split = (text or "").split("\n")
        open_ = []
        for i, x in enumerate(split, 1):
            mark = x.split(" ")[0]
            if not 1 <= len(mark) <= 6 or set(mark) != {"#"} or " " not in x:
                continue
            open_ = [o for o in open_ if o[0] < len(mark)]
            end = next((j - 1 for j in range(i + 1, len(split) + 1) if 1 <= len(m := split[j - 1].split(" ")[0]) <= len(mark) and set(m) == {"#"}), len(split))
            want.add((path, i, ".".join([o[1] for o in open_] + [x.split(" ")[1]]), open_[-1][2] if open_ else None, end))
            open_.append((len(mark), x.split(" ")[1], i))
    files = spark.createDataFrame([("p", p, t, 1) for p, t in enumerate(texts)], "project string, path int, text string, line int").repartition(3)
    assert {(r.path, r.line, r.qualified_name, r.container, r.end_line) for r in headings(files).collect()} == want


def test_names_bind_in_the_nearest_scope(spark):
    declared = [([], "x", "global"), (["a"], "x", "in a"), (["a", "b"], "x", "in b"), (["a", "b"], "y", "y1"), (["a", "b"], "y", "y0"), (["a"], "z", "z"), (["a"], "z", "z"), (["ab"], "w", "w")]
    uses = [(1, ["a", "b", "c"], "x"), (2, ["a"], "x"), (3, ["q"], "x"), (4, ["a", "b"], "y"), (5, ["a", "c"], "z"), (6, ["a", "b"], "w"), (7, [], "x"), (8, ["a"], None), (1, ["a", "b", "c"], "x")]
    got = scopes.bound(spark.createDataFrame(uses, "id int, chain array<string>, word string"), spark.createDataFrame(declared, "scope array<string>, name string, id string"))
    assert sorted((r.id, r.target, r.depth, r.binding) for r in got.collect() if r.id != 8) == [
        (1, "in b", 2, "semantic"), (1, "in b", 2, "semantic"), (2, "in a", 1, "semantic"), (3, "global", 0, "semantic"), (4, "y0", 2, "ambiguous"), (5, "z", 1, "semantic"),
        (6, None, None, "unbound"), (7, "global", 0, "semantic"),
    ]
    assert [(r.target, r.binding) for r in got.where("id = 8").collect()] == [(None, "unbound")]


def test_ordered_digest(spark):
    rows = [(f"k{i}", f"v{i % 7}") for i in range(300)] + [("k5", "again"), ("k5", "again"), (None, None), ("\U0001f44b", "a"), ("", "b")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    size = lambda x: "-" if x is None else f"{len(x.encode())}:{x}"

    def plain(rows, levels):
        now = sorted(((k or "").encode("utf-16-be"), sha(f"{size(k)},{size(v)}"), k or "") for k, v in rows)
        for level in range(1, levels + 1):
            nodes, start = {}, ""
            for k, digest, name in now:
                if sha(name).startswith("0" * level):
                    start = name
                nodes.setdefault(start, []).append(digest)
            now = sorted((k.encode("utf-16-be"), sha("".join(x)), k) for k, x in nodes.items())
        return sha("".join(x for _, x, _ in now))

    frame = lambda r: merkle.tree(spark.createDataFrame(r, "k string, v string").repartition(5), "k", ["k", "v"], levels=2, digits=1)
    one = frame(rows)
    (top,) = one.where("level = 3").collect()
    assert (top.n, top.digest) == (len(rows), plain(rows, 2))
    other = frame([r for r in rows if r[0] != "k77"])
    assert frame(rows[::-1]).where("level = 3").first().digest == top.digest != other.where("level = 3").first().digest
    (changed,) = merkle.differing(one, other).collect()
    assert changed.one_n == changed.other_n + 1
    assert [(r.n, r.digest) for r in frame(rows[:0]).where("level = 3").collect()] == [(0, sha(""))]


def test_line_starts_in_linear_time(spark):
    began = time.time()
    cases = ["a\n" * 1_000_000, "x" * 1_000_000, "\r\n" * 300_000 + "end"]
    got = [tuple(r) for r in spark.createDataFrame([(c,) for c in cases], "t string").select(F.size(tx.line_starts(F.col("t"))), F.element_at(tx.line_starts(F.col("t")), -1)).collect()]
    assert got == [(1_000_001, 2_000_000), (1, 0), (300_001, 600_000)]
    assert time.time() - began < 100
