import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from lodestone.llm.pii import KINDS, bootstrap, find, joined, redacted

#: The rules as plainly stated.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    spans = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def texts():
    rng = random.Random(9)
    parts = ["a@b.c", "x.y@mail-1.example.com", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (523) 555-7040", "+49 30 1234", "@", ".", "_", " ", "é", "😀", "12", "-", "+", "\n", "a@b@c.d.e", "..", "%"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    out += [None, "", "1" * 40, "a" * 50_000, "7 " * 3000, "1.2.3.4 " * 2000, "+" * 100, "4111111111111111"]
    return out


def test_base_spans_match_the_plain_rules(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.c"), (3, "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, base string").repartition(4)
    got = find(docs).select("doc_id", joined("base").alias("b"), joined("spans").alias("s")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(i), brute(t)) for i, t in rows)
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)


def test_patterns_reach_what_the_rules_miss(spark):
    rng = random.Random(4)
    rows = [(i, f"lorem ipsum number dolor please call me at +1 (555) 01{i:02}-99{i:02} today") for i in range(30)]
    rows += [(100 + i, f"sit amet please call me at 555-01{i:02} today") for i in range(3)]
    rows += [(200 + i, f"version {rng.randrange(10)}.{i} of item 77{i} is out") for i in range(40)]
    got = {r.doc_id: (r.b, r.s) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("base").alias("b"), joined("spans").alias("s")).collect()}
    for i in range(3):
        assert got[100 + i] == ("", "phone:27:35")
    assert all(got[200 + i] == ("", "") for i in range(40))
    assert all(b == s != "" for b, s in (got[i] for i in range(30)))


def test_redaction(spark):
    df = find(spark.createDataFrame([(1, "ü a@b.c and 1.2.3.4."), (2, "plain"), (3, None), (4, "+49 30 12.34.56.78 x")], "doc_id long, text string"), ("doc_id", "text"))
    got = {r.doc_id: r.t for r in df.select("doc_id", redacted(F.coalesce("text", F.lit("")), "spans").alias("t")).collect()}
    assert got == {1: "ü [EMAIL] and [IP].", 2: "plain", 3: "", 4: "[PHONE] x"}


def test_long_runs_take_linear_time(spark):
    rows = ["a@b" + ".c.dd" * 200_000, "x a1" + "-" * 1_000_000 + "2 y", "x a1" + "-" * 1_000_000 + " y", "1 " * 500_000, "1" * 1_000_000, "+1" + " " * 1_000_000, "1.2.3.4 a@b.c " * 20_000, "-" * 1_000_000, "." * 999_999 + "7", "a." * 500_000 + "@"]
    began = time.time()
    df = find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ("doc_id", "text"))
    got = {r.doc_id: r for r in df.select("doc_id", F.size("base").alias("n"), joined("base").alias("b"), F.length(redacted(F.col("text"), "spans")).alias("left")).collect()}
    assert time.time() - began < 120
    assert got[0].b == f"email:0:{3 + 5 * 200_000}" and got[0].left == len("[EMAIL]") and got[6].n == 40_000
    assert all(got[i].n == 0 for i in (1, 2, 3, 4, 5, 7, 8, 9))


def test_empty_table(spark):
    assert find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def plain_redaction(text, spans):
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_redaction_of_many_and_overlapping_spans(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abé 😀") for _ in range(3000))
    cases = []
    for n in (1, 2, 255, 256, 257, 700):
        spans = sorted((s := rng.randrange(2900), rng.randrange(4), s + rng.randrange(1, 40)) for _ in range(n))
        cases.append((text, spans))
    cases.append(("a@b.c " * 10_000, [(6 * i, 0, 6 * i + 5) for i in range(10_000)]))
    df = spark.createDataFrame(cases, "text string, spans array<struct<start:int,kind:int,end:int>>")
    began = time.time()
    got = [r.t for r in df.select(redacted(F.col("text"), "spans").alias("t")).collect()]
    assert got == [plain_redaction(*c) for c in cases]
    assert time.time() - began < 30


def test_finding_in_a_text_of_many_spans(spark):
    ((base, spans),) = find(spark.createDataFrame([(1, "x a@b.c 1.2.3.4 " * 5000)], "doc_id long, text string")).select(F.size("base"), F.size("spans")).collect()
    assert (base, spans) == (10_000, 10_000)


def plain_bootstrap(edges, support=3.0, accept=0.8, settles=0.02):
    seeds, by_match, by_pattern = {}, {}, {}
    for p, m, s in edges:
        by_match.setdefault(m, set()).add(p)
        by_pattern.setdefault(p, set()).add(m)
        own = seeds.setdefault(m, [[0.0] * len(KINDS), False])
        if s is not None:
            own[0][s], own[1] = 1.0, True
    now = {m: list(c) for m, (c, _) in seeds.items()}
    moved = 1
    while moved > settles:
        strong, moved = {}, 0
        for p, ms in by_pattern.items():
            sums = [sum(now[m][k] for m in ms) for k in range(len(KINDS))]
            strong[p] = [x / (len(ms) + 1) if x >= support else 0.0 for x in sums]
        for m, (c, known) in seeds.items():
            if not known:
                was, now[m] = now[m], [1 - math.prod(1 - strong[p][k] for p in by_match[m]) for k in range(len(KINDS))]
                moved = max(moved, *(abs(a - b) for a, b in zip(was, now[m])))
    return {(m, c.index(max(c))) for m, c in now.items() if not seeds[m][1] and max(c) >= accept}


def test_bootstrap_matches_the_plain_rounds(spark):
    rng = random.Random(12)
    edges = {(f"p{min(rng.randrange(12), rng.randrange(30))}", f"m{i}", None if i % 4 == 0 else i % 3) for i in range(400) for _ in range(2)}
    edges |= {("hot", f"m{i}", None if i % 4 == 0 else i % 3) for i in range(0, 400, 3)} | {("sure", f"m{i}", 1 if i % 4 else None) for i in range(1, 90, 3)} | {("sure", "m8", None), ("sure", "m400", None)}
    got = bootstrap(spark.createDataFrame(sorted(edges, key=str), "pattern string, match string, seed int"))
    want = plain_bootstrap(edges)
    assert want and {(r.match, r.kind) for r in got.collect()} == want
