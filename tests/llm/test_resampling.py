import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from lodestone.llm import resampling
from lodestone.llm.resampling import cut, resample, words_of

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text, longest=2):
    words = WORDS.findall((text or "").encode().translate(LOWER))
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, share=25, least=20, buckets=10_000, longest=2):
    split = [features(t, longest) for _, t in rows]
    s = Counter(zlib.crc32(f) % buckets for _, fs in split for f in fs)
    t = Counter(zlib.crc32(f) % buckets for x in target for f in features(x, longest)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big + buckets) / ((s[b] + 1.0) * (small + buckets)))) for b in s}
    out = []
    for (name, _), (words, fs) in zip(rows, split):
        weight = math.floor(Fraction(sum(gain[zlib.crc32(f) % buckets] for f in fs), len(fs))) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(able[: share * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def texts(rng, n):
    vocabulary = ["alpha", "Beta", "γάμμα", "x1", "delta's", "e-mail", "ÄÖ", "0", "z" * 63, "z" * 64, "y" * 200, "the", "of"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60, 300]))) for _ in range(n)]


@pytest.mark.parametrize("chunk,longest", [(1 << 16, 2), (50, 2), (90, 3), (40, 1)])
def test_matches_brute_force(spark, chunk, longest):
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, 120), -20)) + [(500, None), (501, ""), (502, "..!"), (None, "one two " * 30), (503, "tab\tand\nline\x00zero " * 9), (503, "again " * 25)]
    target = [*texts(rng, 5), None, "the of the of"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as own", "2 as score").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resample(docs, wanted, longest=longest, chunk=chunk).collect()), key=str)
    assert got == brute(rows, target, longest=longest)


def test_ties_go_to_the_smaller_id_and_repeats_count_each(spark):
    rows = [(i // 2, "same words here again and again " * 6) for i in range(40)]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same words",)], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ["same words"])


def test_chunks_own_their_starts():
    rng = random.Random(9)
    for text in [*texts(rng, 60), "", "   ", "a" * 500, "  a  b  ", "a " * 300 + " " * 400 + "b", "a b" + " " * 1000 + "c" * 900 + " d"]:
        for size in (1, 7, 64):
            for carried in (0, 1, 2):
                parts = list(cut(text.encode(), size, carried))
                words = words_of(text.encode())
                assert [w for own, _ in parts for w in own.split()] == words
                seen = 0
                for own, carry in parts:
                    seen += len(own.split())
                    assert carry.split() == words[seen : seen + carried]


def test_a_huge_text_is_dealt_over_tasks(spark):
    text = "some words of a very long text " * 60_000
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    assert resampling.long_chunks(docs).count() > 20
    assert sorted(tuple(r) for r in resample(docs, docs.limit(0)).select("doc_id", "n_features").collect()) == [(1, 2 * 420_000 - 1), (2, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    assert resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).count() == 1
