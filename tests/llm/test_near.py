import random

from lodestone.llm.common import split_words
from lodestone.llm.near import near_groups


def jaccard(a, b, k=5):
    s, t = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := split_words((x or "").encode())) else set() for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 1.0


def test_groups_are_the_components_of_alike_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0], None, "", "one two", "two one", "x " * 40_000]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    ids = [None if i % 50 == 7 else 1000 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, ids[i], t, 1) for i, t in enumerate(texts)], "row long, doc_id long, text string, same int").repartition(4)
    got = near_groups(docs).collect()
    assert len(got) == len(texts)
    parts, want = {}, {}
    for r in got:
        parts.setdefault(r.group, set()).add(r.row)
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert {frozenset(p) for p in parts.values()} == {frozenset(p) for p in want.values()}
    kept = {r.row for r in got if r.keep}
    assert kept == {min(p, key=lambda i: (ids[i] is None, ids[i] or 0, i)) for p in want.values()}


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "row long, doc_id long, text string")).count() == 0


def brute_groups(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(p) for p in out.values()}


def groups_of(spark, texts):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(4)
    parts = {}
    for r in near_groups(docs).collect():
        parts.setdefault(r.group, set()).add(r.row)
    return {frozenset(p) for p in parts.values()}


def test_near_copies_within_a_template_family(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(170)]
    texts = []
    for _ in range(80):  # members are alike to less than 0.8, a member and its copy to more
        own = [word() for _ in range(rng.randrange(30, 50))]
        copy = [*own[:-2], word(), word()]
        texts += [" ".join(shared + own), " ".join(shared + copy)]
    want = brute_groups(texts)
    assert 20 < len(want) <= 160
    assert groups_of(spark, texts) == want


def test_blocks_appended_or_replaced_at_the_bound(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in range(100, 200, 2):
        base = [word() for _ in range(n)]
        more = round((n - 4) / 0.8) - (n - 4)  # shingles that leave about 0.8
        swap = (n - 4) // 9 - 4
        other = [*base[:20], *(word() for _ in range(swap)), *base[20 + swap :]]
        texts += [" ".join(base), " ".join([*base, *(word() for _ in range(more))]), " ".join(base[: -round((n - 4) * 0.2)]), " ".join(other)]
    want = brute_groups(texts)
    assert sum(len(p) > 1 for p in want) == 50
    assert groups_of(spark, texts) == want
