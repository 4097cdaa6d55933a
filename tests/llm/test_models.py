"""The learned operators: brute-force twins of their figures, held-out accuracy, and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import brown, langid, quality, toxicity
from lodestone.llm.common import split_words
from lodestone.llm.hashing import WordTable, sums

ODD = [(None, "no id at all"), (9001, None), (9002, ""), (9003, " \t "), (9004, "12 34 !"), (9005, "word " * 30_000), (1, "a second row of one id")]
SYLLABLES = {"aa": "ka lo mi ne tu ra".split(), "bb": "ersch tz pf ung lich ver".split(), "cc": "eau oue ment tion ais ique".split()}


def words_of(lang, rng, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def corpus(rng, rows=360):
    out = []
    for i in range(rows):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join(words_of(lang, rng, rng.randrange(8, 60))), lang))
    return out


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as held_out", "1 as score", "2 as word", "3 as chunk").repartition(5)


def test_lm_base_figures_and_gain(spark):
    rng = random.Random(1)
    rows = corpus(rng) + [(i, t, None) for i, t in ODD]
    got = brown.score_documents(frame(spark, rows), classes=6, chunk_tokens=3000).collect()
    assert len(got) == len(rows)
    train = [split_words((t or "").encode()) for i, t, _ in rows if i is not None and crc(i, 5) != 1]
    c = Counter(w for ws in train for w in ws)
    c[None] = len(train)
    n, v = sum(c.values()), len(c)

    def base(ws):
        return sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])

    want = Counter()
    for i, t, _ in rows:
        ws = split_words((t or "").encode())
        want[i, None if i is None else crc(i, 5) == 1, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(base(ws), 6)] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # scores are below zero
    assert all(r.score < 0 for r in got)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    plain, unknown = rng.integers(0, 50, (8, 8)).astype(float), rng.integers(0, 9, (8, 8)).astype(float)
    plain[:, -1] = 0
    assert np.allclose((10 ** brown.log_table(plain, unknown)).sum(1), 1)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    group = rng.integers(0, 3, 40)
    pairs = rng.poisson(np.where(group[:, None] == group[None, :], 6, 0.5)).astype(float)
    pairs = np.pad(pairs, ((0, 1), (0, 1)), constant_values=2)
    of, n = brown.exchange(pairs, 3)

    def likelihood(classes):
        one = np.zeros((41, 4))
        one[np.arange(41), [*classes, 3]] = 1
        m = one.T @ pairs @ one
        return (brown._nlogn(m).sum() - brown._nlogn(m.sum(0)).sum() - brown._nlogn(m.sum(1)).sum()), m

    best, m = likelihood(of)
    assert np.allclose(m, n)
    assert best >= likelihood(np.arange(40) % 3)[0]
    for w in range(40):  # no single move is better
        for b in range(3):
            other = of.copy()
            other[w] = b
            assert likelihood(other)[0] <= best + 1e-6


def test_lm_matches_a_plain_model(spark):
    """Classes, transitions and scores worked out over plain lists of words, from the core's classes on."""
    rng = random.Random(17)
    rows = corpus(rng, 120) + [(i, t, None) for i, t in ODD if len(t or "") < 1000]
    k, core, rounds = 4, 25, 3
    df = frame(spark, rows)
    named = df.selectExpr("doc_id", "crc32(cast(doc_id as string)) % 5 = 1 as held_out", "cast(text as binary) as t")
    model = brown.learn(named, k, core, rounds, 400, 200, 60)  # many chunks and parts
    found = {bytes(r.word): (r.c, r.cls) for r in brown.vocabulary(model.numbered, model.classes).collect()}
    train = [split_words((t or "").encode()) for i, t, _ in rows if i is not None and crc(i, 5) != 1]
    c = Counter(w for ws in train for w in ws)
    assert {w: n for w, (n, _) in found.items() if n} == c
    frequent = sorted(w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:core])
    index = {w: i for i, w in enumerate(frequent)}
    pairs = np.zeros((len(index) + 1, len(index) + 1))
    bigrams = Counter()
    for ws in train:
        for a, b in zip([None, *ws], [*ws, None]):
            bigrams[a, b] += 1
            if (a is None or a in index) and (b is None or b in index):
                pairs[index.get(a, len(index)), index.get(b, len(index))] += 1
    of, counts = brown.exchange(pairs, k)
    fixed = {w: int(of[i]) for w, i in index.items()}
    now = {**fixed, None: k}
    done, before = 0, None
    while done < rounds:
        if done:
            counts = np.zeros((k + 1, k + 1))
            for (a, b), n in bigrams.items():
                counts[now[a], now[b]] += n
            reached = brown.likelihood(counts)
            if before is not None and reached <= before + brown.SETTLED * abs(before):
                break
            before = reached
        gains, usual = brown._gains(counts), int(counts.sum(0)[:k].argmax())
        sums_ = {w: np.zeros(k) for w in c}
        met = set()
        for (a, b), n in bigrams.items():
            if b is not None and a in now:
                sums_[b] += n * gains[now[a]]
                met.add(b)
            if a is not None and b in now:
                sums_[a] += n * gains[k + 1 + now[b]]
                met.add(a)
        now = {**{w: int(x.argmax()) if w in met else usual for w, x in sums_.items()}, **fixed, None: k}
        done += 1
    assert model.rounds == done
    same = sum(found[w][1] == now[w] for w in c)
    assert same >= 0.99 * len(c)  # sums are single floats there: ties may fall otherwise
    cls = {w: found[w][1] for w in c}
    totals = Counter()
    for w, n in c.items():
        totals[cls[w]] += n
    assert [totals[j] for j in range(k)] == model.totals.tolist()

    def states(ws, single):
        return [k, *((k + 1 if w not in c or (single and c[w] == 1) else cls[w]) for w in ws), k]

    plain, unknown = np.zeros((k + 2, k + 2)), np.zeros((k + 2, k + 2))
    for ws in train:
        for table, single in ((plain, False), (unknown, True)):
            s = states(ws, single)
            for a, b in zip(s, s[1:]):
                table[a, b] += 1
    logs = brown.log_table(plain, unknown)
    got = Counter((r.doc_id, round(r.score, 6)) for r in brown.score_documents(df, classes=k, core=core, rounds=rounds, chunk_tokens=400, chunk_words=200, part_words=60).collect())
    want = Counter()
    for i, t, _ in rows:
        ws = split_words((t or "").encode())
        s = states(ws, False)
        want[i, round(sum(logs[a, b] for a, b in zip(s, s[1:])) + sum(math.log10(c[w] / totals[cls[w]]) for w in ws if w in c), 6)] += 1
    assert got == want


def test_classes_of_words_that_are_all_rare(spark):
    rng = random.Random(9)
    odd, even = ([f"{x}{i}" for i in range(60)] for x in "oe")
    rows = [(i, " ".join(rng.choice((odd, even)[j % 2]) for j in range(40))) for i in range(300)]
    got = brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), classes=2, core=20, chunk_tokens=3000).collect()
    held = [r for r in got if r.held_out]  # to know a word's kind is worth log10 2 a token
    assert sum(r.score - r.base_score for r in held) > 0.25 * sum(r.n_tokens for r in held)


def test_lm_without_training_rows(spark):
    i = next(i for i in range(100) if crc(i, 5) == 1)
    (r,) = brown.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert brown.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(4)
    steps = rng.normal(size=(3, 3))
    lengths = np.array([1, 5, 0, 17, 64, 65, 200])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got, at = langid.forward_backward(scores, lengths, steps, block=16), 0
    for n in lengths:
        e, a = np.exp(scores[at : at + n]), np.exp(steps)
        f, g, x = np.empty_like(e), np.ones_like(e), np.full(3, 1 / 3)
        for i in range(n):
            x = (x @ a) * e[i]
            x /= x.sum()
            f[i] = x
        for i in range(n - 2, -1, -1):
            g[i] = a @ (e[i + 1] * g[i + 1])
            g[i] /= g[i].sum()
        p = f * g
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True) if n else p)
        at += n


def test_language_of_held_out_texts(spark):
    rng = random.Random(5)
    rows = corpus(rng) + [(i, t, "aa") for i, t in ODD]
    got = langid.identify(frame(spark, rows), most=200).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, t, x in rows[:360]}
    held = [r for r in got if r.held_out and r.doc_id in lang and r.doc_id != 1]
    assert len(held) > 50 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in got if r.doc_id is not None)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (9001, 9002, 9003, 9004):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(frame(spark, rows).limit(0)).count() == 0
    nothing = langid.identify(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert nothing.lang_pred == "und"


def test_words_of_mixed_texts_keep_their_languages():
    rng = random.Random(6)
    labels = list(SYLLABLES)
    samples = [([w.encode() for w in words_of(x, rng, 60)], labels.index(x)) for x in labels for _ in range(60)]
    model = langid.train(samples, labels, number=300)
    words = [w.encode() for x in ("aa", "cc", "bb") for w in words_of(x, rng, 20)]
    table = WordTable(lambda ws: (model.emissions(ws),))
    at = table.rows(words)
    p = langid.forward_backward(table.arrays[0][at], np.array([60]), model.steps)
    assert (p.argmax(1) == np.repeat([0, 2, 1], 20)).mean() > 0.93


@pytest.mark.parametrize("bad", ["junk", "repeat"])
def test_quality_of_held_out_texts(spark, bad):
    rng = random.Random(7)
    rows, labels = [], []
    for i, t, _ in corpus(rng, 400):
        y = int(rng.random() < 0.8)
        if not y:
            ws = t.split()
            t = " ".join(w + rng.choice(["%%%", "***"]) for w in ws) if bad == "junk" else " ".join(w for w in ws[:6] for _ in range(9))
        rows.append((i, t, None))
        labels.append((i, y))
    df = frame(spark, rows + [(i, t, None) for i, t in ODD])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (77_777, 0)], "doc_id long, quality int")
    got = quality.quality(df, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 1]
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality(df.limit(0), marks).count() == 0
    assert {r.score for r in quality.quality(df, marks.limit(0)).collect()} == {0.5}


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(8)
    insults = "grobian scumlord wretchedly numbskull".split()
    rows, labels = [], []
    for i, t, _ in corpus(rng, 600):
        y = int(rng.random() < 0.25)
        ws = t.split()
        for _ in range(3 * y):
            ws.insert(rng.randrange(len(ws)), rng.choice(insults))
        rows.append((i, " ".join(ws), None))
        labels.append((i, y))
    df = frame(spark, rows + [(i, t, None) for i, t in ODD])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 1]
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in got if r.doc_id is not None)
    flat = toxicity.toxicity(df, marks.where(F.col("toxic") == 0)).collect()
    assert {r.score for r in flat} == {0.0}
    assert toxicity.toxicity(df.limit(0), marks).count() == 0


def labelled_texts(rng, rows=600):
    insults = "grobian scumlord wretchedly numbskull".split()
    out, labels = [], []
    for i, t, _ in corpus(rng, rows):
        y = int(rng.random() < 0.25)
        ws = t.split()
        for _ in range(3 * y):
            ws.insert(rng.randrange(len(ws)), rng.choice(insults))
        out.append((i, " ".join(ws), None))
        labels.append((i, y))
    return out, labels


def test_toxicity_scores_match_window_lengths_worked_out_plainly(spark):
    rows, labels = labelled_texts(random.Random(13))
    truth = dict(labels)
    model = toxicity.train([(t.encode(), truth[i]) for i, t, _ in rows if crc(i, 3) != 1])
    assert len(model.curve) and b"grobian" in model.toxic and b"grobian" not in model.ordinary
    options = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(content, window):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=zstandard.ZstdCompressionParameters(**options)).compress(window))

    def plain_score(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        saved, at = [], 0
        while words:
            window = (" " + " ".join(words[at : at + 4]) + " the of and in ").encode()
            saved.append(length(model.ordinary, window) - length(model.toxic + model.ordinary, window))
            at += 2
            if at + 2 >= len(words):
                break
        n = [sum(x >= s for x in saved) for s in (2, 4, 6)]
        inputs = [1, *(math.log(1 + x) for x in n), *(math.log((x + 0.05) / (len(saved) + 20)) for x in n), math.log(1 + len(saved))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(inputs, model.curve))))

    some = [*rows[:60], *((i, t, None) for i, t in ODD if len(t or "") < 1000), (8000, "one", None), (8001, "One two three four five", None), (8002, "a b c d e f", None)]
    got = toxicity.score(frame(spark, some), model).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == Counter((i, round(plain_score(t), 9)) for i, t, _ in some)


def test_columns_of_the_same_names_as_results_are_ignored(spark):
    rows, labels = labelled_texts(random.Random(14), 200)
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = plain.selectExpr("*", "doc_id as k", "'a' as y", "0.5 as score", "1 as predicted", "'t' as t", "true as held_out", "3 as h")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "toxic as quality", "'x' as text", "1 as k", "2 as score")
    for operator in (toxicity.toxicity, quality.quality):
        assert sorted(map(tuple, operator(clash, marks).collect())) == sorted(map(tuple, operator(plain, marks.select("doc_id", "toxic", "quality")).collect()))


def test_quality_scores_match_a_plain_sum_over_features(spark):
    rows, labels = labelled_texts(random.Random(15), 150)
    truth = dict(labels)
    model = quality.train([(t.encode(), truth[i]) for i, t, _ in rows if crc(i, 5) != 0], epochs=2)
    mask, golden = 2**64 - 1, 0x9E3779B97F4A7C15

    def bucket(code, kind):
        x = (code + kind * 0x51ED270B + 1) * golden & mask
        x ^= x >> 29
        return (x * golden & mask) >> (64 - quality.BITS)

    def code_of(word, base=1_000_003, start=0, one=1):
        code = start
        for c in word:
            code = (code * base + c + one) & mask
        return code

    def plain_score(text):
        words = (text or "").encode().split()
        found = []
        for w in words:
            m = b"<" + w + b">"
            found.append(bucket(code_of(m, start=len(m)), 0))
            found += [bucket(code_of(m[i : i + n], 257, 0, 0), n) for n in quality.GRAMS for i in range(len(m) - n + 1)]
        codes = [code_of(w, start=len(w)) for w in words]
        found += [bucket(1 if a == b else (a * 31 + b) & mask, quality.BIGRAM) for a, b in zip(codes, codes[1:])]
        logit = (model.always + sum(float(model.gain[i]) for i in found)) / (1 + len(found))
        return 1 / (1 + math.exp(-logit))

    some = [*rows[:40], *((i, t, None) for i, t in ODD if len(t or "") < 1000), (8003, "same same same other", None)]
    got = quality.score(frame(spark, some), model).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == Counter((i, round(plain_score(t), 9)) for i, t, _ in some)


def test_quality_training_is_plain_gradient_descent():
    rows, dims, epochs, rate = [(b"good good text", 1), (b"bad text", 0), (b"good", 1)], 4, 3, 0.6
    got = quality.train(rows, dims=dims, epochs=epochs, rate=rate, seed=5)
    rng = np.random.default_rng(5)
    size = 1 << quality.BITS
    vectors = rng.uniform(-1 / dims, 1 / dims, (size + 1, dims)).astype(np.float32)
    start, moved, out = vectors.copy(), set(), [[0.0] * dims, [0.0] * dims]
    done, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            words, y = rows[i][0].split(), rows[i][1]
            ids = [int(x) for w in words for x in quality.features([b"<" + w + b">"], quality.BITS, quality.GRAMS)[0]]
            ids += [int(quality._pairs(quality.word_codes([a, b]))[0]) for a, b in zip(words, words[1:])] + [size]
            share = {x: n / len(ids) for x, n in Counter(ids).items()}
            hidden = [sum(w * float(vectors[x][d]) for x, w in share.items()) for d in range(dims)]
            logits = [sum(o * h for o, h in zip(row, hidden)) for row in out]
            p = [math.exp(z - max(logits)) for z in logits]
            p = [z / sum(p) - (j == y) for j, z in enumerate(p)]
            step, square = rate * (1 - done / steps), max(sum(w * w for w in share.values()), 1e-3)
            back = [p[0] * out[0][d] + p[1] * out[1][d] for d in range(dims)]
            out = [[out[j][d] - step * p[j] * hidden[d] for d in range(dims)] for j in (0, 1)]
            for x, w in share.items():
                moved.add(x)
                for d in range(dims):
                    vectors[x][d] -= step * w / square * back[d] * 0.05
            done += 1
    want = vectors.astype(float) @ (np.array(out[1]) - np.array(out[0]))
    assert np.allclose(got.gain, want[:-1], atol=1e-6) and math.isclose(got.always, want[-1], abs_tol=1e-6)
    assert any((vectors[x] != start[x]).any() for x in moved)


def test_sums_of_runs():
    assert sums(np.arange(6.0), np.array([2, 0, 3, 1, 0])).tolist() == [1.0, 0.0, 9.0, 5.0, 0.0]


def test_numbers_are_no_letters():
    assert not any(langid.has_letter(x.encode()) for x in ("", "²", "½", "Ⅷ", "①", "12 _ -", "\u0661"))
    assert all(langid.has_letter(x.encode()) for x in ("a", "1é", "日", "²x"))
