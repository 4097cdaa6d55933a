import random

import pytest
import xxhash

from lodestone.llm import common
from lodestone.llm.simhash import links, near_duplicates


def brute_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, most=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_documents_match_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd Ef gh ij kl".split()) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), None, "", " \t", "one", "one two", "é\x1cx y z", "long " * 30000]
    ids = [*range(100, 100 + len(texts) - 2), None, 100]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, cell string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id or -1) for r in near_duplicates(docs).collect())
    prints = [brute_print(t) for t in texts]
    want = brute_components(ids, prints)
    assert got == sorted((i is None, i or 0, f"{p:016x}", -1 if c is None else c) for i, p, c in zip(ids, prints, want))


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("crowd", [2, 64])
def test_links_give_the_components_of_all_close_pairs(spark, most, crowd):
    rng = random.Random(most)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    fps = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = [(r.a, r.b) for r in links(fps, most, crowd).collect()]
    near = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= most}

    def classes(pairs):
        root = {x: x for x in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(b)] = find(a)
        parts = {}
        for x in prints:
            parts.setdefault(find(x), set()).add(x)
        return {frozenset(p) for p in parts.values()}

    assert classes(found) == classes(near)
    if crowd == 64:
        assert {tuple(sorted(p)) for p in found} == near


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_go_on_until_settled(spark, monkeypatch):
    monkeypatch.setattr(common, "range", lambda n: [0], raising=False)  # a bound on the rounds would end them here
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in common.components(edges).collect()} == {0}


def test_a_hot_key_is_joined_where_it_lies(spark):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, -1, id) as key", "id")
    right = spark.range(-1, 4000).selectExpr("id as key", "id * 2 as twice")
    got = common.joined_apart(left, right, "key")
    assert sorted(map(tuple, got.select("key", "id", "twice").collect())) == sorted(map(tuple, left.join(right, "key").select("key", "id", "twice").collect()))
    assert common.joined_apart(left.limit(0), right, "key").count() == 0


def test_components_around_hubs(spark):
    rng = random.Random(21)
    edges = [(5000 if i % 2 else 3, i) for i in range(10, 900)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(180)] + [(7000 + i, 7001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(n, find(n)) for e in edges if e[0] != e[1] for n in e}
    assert {tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
