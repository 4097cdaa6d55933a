"""Language identification: a linear-chain CRF over words, read off by forward-backward."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, slices, table
from lodestone.llm.hashing import WordTable, features, sums
from lodestone.llm.labelled import window

BITS = 17
GRAMS = (1, 2, 3)
AFFIXES = (2, 3)
#: Labelled rows that the model is fitted on, shared out evenly over all languages, and characters of each one's window, at most.
MOST_ROWS = 2400
WINDOW_CHARS = 1200
BLOCK = 64
#: ASCII bytes that are no letters part words.
LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of letters and of what is not ASCII."""
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()


def has_letter(text: bytes) -> bool:
    """Whether some character is of a letter category; numbers such as ², ½, Ⅷ and ① are not."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Affixes and n-grams of the word, and its entry in the lexicon of whole words."""
    return features([b"<" + w + b">" for w in words], BITS, GRAMS, AFFIXES)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    steps: np.ndarray  # label before x label after

    def emissions(self, words: list[bytes]) -> np.ndarray:
        ids, owner = word_features(words)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        return np.stack([np.bincount(owner, w[ids], len(words)) for w in self.weights.T], 1) / np.sqrt(n)[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of each word's label for consecutive sequences of so many words.

    Sequences are cut into blocks. The product of a block's matrices carries messages over it, so that blocks of all sequences
    move a word at a time together; messages at block borders are then passed along each sequence, and
    each block is filled in from its borders. This is forward-backward, not an approximation.
    """
    k = scores.shape[1]
    move = np.exp(steps - steps.max())
    e = np.exp(scores - scores.max(1, keepdims=True))
    lengths = lengths[lengths > 0]
    per = -(-lengths // block)
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    nb = int(per.sum())
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    nth = np.arange(nb) - np.repeat(first, per)
    start = np.repeat(starts, per) + nth * block
    size = np.minimum(block, np.repeat(starts + lengths, per) - start)
    at = np.minimum(start[:, None] + np.arange(block), len(e) - 1)
    real = np.arange(block) < size[:, None]
    grid = e[at]
    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        on = real[:, t]
        if not on.any():
            break
        new = (product.reshape(-1, k) @ move).reshape(nb, k, k) * grid[:, t, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        product[on] = new[on]
    ahead = np.full((nb, k), 1 / k)
    behind = np.ones((nb, k))
    for j in range(1, int(per.max())):
        b = first[per > j] + j
        x = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
        ahead[b] = x / x.sum(1, keepdims=True)
    for j in range(int(per.max()) - 2, -1, -1):
        b = first[per > j + 1] + j
        x = np.einsum("bij,bj->bi", product[b + 1], behind[b + 1])
        behind[b] = x / x.sum(1, keepdims=True)
    forward = np.empty((nb, block, k))
    x = ahead
    for t in range(block):
        new = (x @ move) * grid[:, t]
        x = np.where(real[:, t, None], new / new.sum(1, keepdims=True), x)
        forward[:, t] = x
    x = behind
    for t in range(block - 1, -1, -1):
        forward[:, t] *= x
        new = (grid[:, t] * x) @ move.T
        x = np.where(real[:, t, None], new / new.sum(1, keepdims=True), x)
    out = forward[real]
    return out / out.sum(1, keepdims=True)


def spliced(samples: list[tuple[list[bytes], int]], number: int, length: int, rng: np.random.Generator) -> list[tuple[list[bytes], np.ndarray]]:
    """Code-switched sequences for fitting: runs of 5 to 25 words from samples drawn at random, one after another."""
    out = []
    while len(out) < number:
        words: list[bytes] = []
        labels: list[int] = []
        while len(words) < length:
            own, y = samples[rng.integers(len(samples))]
            run = int(rng.integers(5, 26))
            at = int(rng.integers(max(1, len(own) - run + 1)))
            words += own[at : at + run]
            labels += [y] * len(own[at : at + run])
        out.append((words[:length], np.array(labels[:length])))
    return out


def train(samples: list[tuple[list[bytes], int]], labels: list[str], number: int = 1500, length: int = 40, epochs: int = 4, batch: int = 50, rate: float = 0.5, decay: float = 1e-4, seed: int = 42) -> Crf:
    """Conditional likelihood by AdaGrad on batches of spliced sequences; the gradient is observed less expected features."""
    rng = np.random.default_rng(seed)
    k = len(labels)
    model = Crf(labels, np.zeros((1 << BITS, k)), np.zeros((k, k)))
    samples = [s for s in samples if s[0]]
    if k < 2 or not samples:
        return model
    data = spliced(samples, number, length, rng)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(w for w, _ in data)))}
    ids, owner = word_features(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    ids, counts = ids[order], np.bincount(owner, minlength=len(vocabulary))
    begin = np.concatenate(([0], np.cumsum(counts)))
    x = np.array([[vocabulary[w] for w in words] for words, _ in data])
    y = np.stack([y for _, y in data])
    seen, seen_steps = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)):
            words, which = np.unique(x[part], return_inverse=True)
            n = counts[words]
            feature = ids[np.concatenate([np.arange(begin[w], begin[w + 1]) for w in words])]
            of = np.repeat(np.arange(len(words)), n)
            scale = 1 / np.sqrt(n)
            score = np.stack([np.bincount(of, model.weights[feature, j], len(words)) for j in range(k)], 1) * scale[:, None]
            e = score[which.reshape(x[part].shape)]
            b, t = e.shape[:2]
            move = np.exp(model.steps)
            e = np.exp(e - e.max(2, keepdims=True))
            f, g = np.empty_like(e), np.ones_like(e)
            f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for i in range(1, t):
                f[:, i] = (f[:, i - 1] @ move) * e[:, i]
                f[:, i] /= f[:, i].sum(1, keepdims=True)
            for i in range(t - 2, -1, -1):
                g[:, i] = (e[:, i + 1] * g[:, i + 1]) @ move.T
                g[:, i] /= g[:, i].sum(1, keepdims=True)
            p = f * g
            p /= p.sum(2, keepdims=True)
            pair = f[:, :-1, :, None] * move * (e * g)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            own = y[part]
            error = np.eye(k)[own] - p
            by_word = np.stack([np.bincount(which.ravel(), error[:, :, j].ravel(), len(words)) for j in range(k)], 1) * scale[:, None] / b
            touched, where = np.unique(feature, return_inverse=True)
            grad = np.stack([np.bincount(where, by_word[of, j], len(touched)) for j in range(k)], 1) - decay * model.weights[touched]
            seen[touched] += grad**2
            model.weights[touched] += rate * grad / np.sqrt(seen[touched])
            observed = np.zeros((k, k))
            np.add.at(observed, (own[:, :-1].ravel(), own[:, 1:].ravel()), 1)
            grad = (observed - pair.sum((0, 1))) / (b * t) - decay * model.steps
            seen_steps += grad**2
            model.steps += rate * grad / np.sqrt(seen_steps)
    return model


def labelled_texts(docs: DataFrame, most: int = MOST_ROWS, chars: int = WINDOW_CHARS, seed: int = 42) -> list[tuple[bytes, str]]:
    """At most `most` (window, lang) rows of documents with a language and a text, as many of each language, by a seeded hash; of more
    languages than that, one row each. Every language that occurs is learned."""
    named = docs.where("lang is not null and text is not null")
    counts = named.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return []
    each = max(1, most // len(counts))
    share = F.create_map(*chain.from_iterable((F.lit(r.lang), F.lit(min(1.0, 1.5 * each / r["count"] + 20 / r["count"]))) for r in counts))
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    place = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    rows = named.select("lang", place.alias("p"), window(F.col("text"), seed, chars).cast("binary").alias("t")).where(F.col("p") < F.try_element_at(share, "lang"))
    got = sorted(rows.collect(), key=lambda r: (r.lang, r.p, bytes(r.t)))
    out, held = [], {}  # the shares leave about 1.5 times `most` rows and 20 a language
    for r in got:
        held[r.lang] = held.get(r.lang, 0) + 1
        if held[r.lang] <= each:
            out.append((bytes(r.t), r.lang))
    return out


def annotate(docs: DataFrame, model: Crf) -> DataFrame:
    """Adds lang_pred and score to the columns of docs, from every row's whole text.

    score is the mean marginal of the predicted language over the words. A text that is null or without a letter, and any
    text if nothing was learned, is `und` with score 0.
    """
    labels = np.array([*model.labels, "und"], dtype=object)
    k = len(model.labels)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(lambda words: (model.emissions(words),))
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at_text).cast(pa.binary()).to_pylist()
                words = [words_of(t) if t else [] for t in texts]
                for i, w in enumerate(words):
                    if not w or not has_letter(w[0]) and not has_letter(texts[i]):
                        words[i] = []
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                best, score = np.full(len(words), k), np.zeros(len(words))
                if k and lengths.sum():
                    at = known.rows(list(chain.from_iterable(words)))
                    mass = sums(forward_backward(known.arrays[0][at], lengths, model.steps), lengths) / np.maximum(lengths, 1)[:, None]
                    best = np.where(lengths > 0, mass.argmax(1), k)
                    score = np.where(lengths > 0, np.clip(mass.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[best], pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Crf, mod: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", mod) == held).alias("held_out"), "text")
    return annotate(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def fit(docs: DataFrame, mod: int = 4, held: int = 2, most: int = MOST_ROWS, seed: int = 42) -> Crf:
    """Fits on documents with a language whose crc32(doc_id) mod `mod` is not `held`."""
    rows = labelled_texts(docs.where(crc_mod("doc_id", mod) != held), most, seed=seed)
    labels = sorted({lang for _, lang in rows})
    return train([(words_of(t), labels.index(lang)) for t, lang in rows], labels, seed=seed)


def identify(docs: DataFrame, most: int = MOST_ROWS, seed: int = 42) -> DataFrame:
    """Fits on a bounded sample outside the held-out quarter and predicts all rows (see `predict`).

    A null doc_id keeps its row, held_out null. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    return predict(docs, fit(docs, most=most, seed=seed))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
