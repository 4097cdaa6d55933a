import hashlib
import random

from lodestone.llm.imatch import Prints, fingerprints, lexicon, likeness, text_of


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randrange(60))) for _ in range(120)]
    texts += [texts[5], None, "", "é ü Ä", "solo", "long " * 40000, texts[5].upper()]
    ids = [*rng.sample(range(10_000), len(texts) - 2), None, 77]
    return list(zip(ids, texts))


def brute_lexicon(rows):
    sets = [set("".join(c.lower() if c.isascii() else c for c in t or "").split()) for _, t in rows]
    df = {}
    for s in sets:
        for w in s:
            df[w] = df.get(w, 0) + 1
    return sorted(w.encode() for w, c in df.items() if len(rows) / 500 <= c <= len(rows) / 5)


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, part string, edge int").repartition(5)
    terms = lexicon(docs)
    assert terms == brute_lexicon(rows)
    prints = Prints(terms)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own = prints.of(t.encode())
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), text_of(own), text_of(prints.of(new.encode())), likeness(own, prints.of(new.encode())), likeness(own, prints.of(after.encode()))))
    got = [tuple(r) for r in fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_likeness_grows_with_what_is_shared():
    terms = [f"t{i:04}".encode() for i in range(3000)]
    prints = Prints(terms)
    rng = random.Random(2)
    base = rng.sample(terms, 300)
    other = [t for t in terms if t not in base]
    near = [likeness(prints.of(b" ".join(base)), prints.of(b" ".join(base[k:] + rng.sample(other, k)))) for k in (0, 3, 30, 150, 300)]
    assert near[0] == 1 and near[1] > 0.6 and near[2] > near[4] and near[1] > near[3] > near[4] and near[-1] < 0.1
    assert prints.of(b" ".join(base)) == prints.of(b"\t".join(base[::-1]))


def test_one_row_and_none(spark):
    schema = "doc_id long, text string"
    assert fingerprints(spark.createDataFrame([], schema)).count() == 0
    (r,) = fingerprints(spark.createDataFrame([(3, "abcd")], schema)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_lexicon_holds_the_whole_band(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(45_000))) for i in range(5)]
    assert len(lexicon(spark.createDataFrame(rows, "doc_id long, text string"))) == 225_000
