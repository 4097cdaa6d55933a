import hashlib
import random

import numpy as np
import pytest

from lodestone.llm.suffixes import classes, collection, covered, drop_repeated, range_least, segments


def brute(rows, least):
    texts = [(name, (t or "").encode()) for name, t in rows]
    first = {}
    for name, t in texts:
        if name is not None:
            for p in range(len(t) - least + 1):
                s = t[p : p + least]
                first[s] = min(first.get(s, name), name)
    out = []
    for name, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - least + 1):
            f = first.get(t[p : p + least])
            if f is not None and (name is None or f < name):
                gone[p : p + least] = [True] * least
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((name, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n, alphabet="ab", longest=80):
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    passages = ["".join(rng.choice(alphabet + "xyz é👋") for _ in range(30)) for _ in range(4)]
    return [t[: len(t) // 2] + rng.choice(passages) * rng.choice([0, 1, 2]) + t[len(t) // 2 :] for t in texts]


@pytest.mark.parametrize("least,anchor", [(6, 3), (12, 5), (8, 8)])
@pytest.mark.parametrize("hot", [1, 1000])
def test_matches_brute_force(spark, least, anchor, hot):
    rng = random.Random(least + hot)
    rows = list(enumerate(corpus(rng, 60), -7))
    rows += [(90, None), (91, ""), (92, "a" * 300), (93, "ab" * 200), (94, rows[3][1]), (94, rows[5][1] + "q"), (None, rows[9][1] + "new"), (None, rows[9][1] + "new"), (3, rows[12][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as chunk", "1 as names").repartition(4)
    got = drop_repeated(docs, least, anchor, chunk_bytes=300, part_keys=60, bucket_bytes=900, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, least)


def test_production_parameters(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "three", "größer", "ναι"]) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    passage = " ".join("abcdefghij"[rng.randrange(10)] * rng.randint(1, 9) for _ in range(30))
    rows = [(i, t[: i % 50] + passage + t[i % 50 :] if i % 3 else t) for i, t in enumerate(texts)] + [(200, texts[7]), (201, texts[7]), (-1, "z" * 100_000), (300, "z" * 1000), (301, passage[:49]), (302, passage[:50])]
    got = drop_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 50)


def test_transform_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        least = rng.randint(1, 6)
        strings = [bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 12))]
        suffixes = sorted([([(1, c) for c in s[p:]] + [(0, i)], i, p) for i, s in enumerate(strings) for p in range(len(s) + 1)])
        symbols = sorted(set(b"".join(strings)))
        bwt, common = collection(strings, least)
        assert bwt.tolist() == [symbols.index(strings[i][p - 1]) + 1 if p else 0 for _, i, p in suffixes]
        shared = [next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for (x, _, _), (y, _, _) in zip(suffixes, suffixes[1:])]
        assert common.tolist() == [0, *(min(n, least) for n in shared)]
        number, first = classes(strings, least)
        runs = [s[p : p + least] for s in strings for p in range(len(s) - least + 1)]
        assert first[-1] == len(runs) and len({*zip(runs, number.tolist())}) == len({*runs}) == len({*number.tolist()})


def test_all_byte_values_and_long_ranges():
    rng = np.random.default_rng(3)
    strings = [bytes(range(256)), rng.integers(0, 256, 900, np.uint8).tobytes(), bytes(range(100, 256))]
    number, first = classes(strings, 7)
    assert number[first[2] : first[3]].tolist() == number[100 : 100 + first[3] - first[2]].tolist()
    values = rng.integers(0, 200, 5000).astype(np.uint8)
    start = rng.integers(0, 4999, 300)
    end = np.minimum(5000, start + 1 + rng.integers(0, 4000, 300))
    assert range_least(values, start, end).tolist() == [values[a:b].min() for a, b in zip(start, end)]


def test_segments_hold_each_string_once():
    rng = random.Random(6)
    for text in [b"", b"a" * 49, b"a" * 50, b"a" * 700_000, bytes(rng.choice(b"abc ") for _ in range(600_000))]:
        data = np.frombuffer(text, np.uint8)
        key, start, size = segments(data, 50, 24)
        assert size.max(initial=0) <= 27 and (start[1:] == start[:-1] + size[:-1]).all() and size.sum() == max(0, len(text) - 49)
    a, b = segments(np.frombuffer(b"x" * 90 + b"some words that come in both of the texts, more than fifty bytes", np.uint8), 50, 24), segments(np.frombuffer(b"some words that come in both of the texts, more than fifty bytes" + b"y" * 40, np.uint8), 50, 24)
    assert {*a[0].tolist()} & {*b[0].tolist()}
    assert covered(np.array([2, 3, 20]), 30, 5).nonzero()[0].tolist() == [*range(2, 8), *range(20, 25)]


def test_empty_tables(spark):
    assert drop_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r)[:4] for r in drop_repeated(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0)]
