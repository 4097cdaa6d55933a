"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, numpy SGD."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, slices, table
from lodestone.llm.hashing import WordTable, bucket, features, sums, word_codes
from lodestone.llm.labelled import labelled_sample

BITS = 18
GRAMS = (3, 4)
#: Rows that the classifier is fitted on, at most.
MOST_ROWS = 4000
BIGRAM = 7


def _marked(words: list[bytes]) -> list[bytes]:
    return [b"<" + w + b">" for w in words]


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Buckets of word pairs; a word after itself is one feature, whichever the word."""
    with np.errstate(over="ignore"):
        return bucket(np.where(codes[:-1] == codes[1:], np.uint64(1), codes[:-1] * np.uint64(31) + codes[1:]), BIGRAM, BITS)


@dataclass
class Model:
    """Of each bucket's vector the scoring needs only its part in the logit of label 1 against 0; `always` is the constant feature's."""

    gain: np.ndarray
    always: float


def train(rows: list[tuple[bytes, int]], dims: int = 16, epochs: int = 6, rate: float = 0.6, seed: int = 42) -> Model:
    """Stochastic gradient descent on the softmax loss; each step moves the document's feature vectors and the output."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    vectors = rng.uniform(-1 / dims, 1 / dims, (size + 1, dims)).astype(np.float32)
    out = np.zeros((2, dims), np.float32)
    examples = []
    for text, y in rows:
        words = text.split()
        counts = Counter(words)
        distinct = list(counts)
        ids, owner = features(_marked(distinct), BITS, GRAMS)
        weight = np.fromiter(counts.values(), np.float64, len(distinct))[owner] if distinct else np.zeros(0)
        ids = np.concatenate([ids, _pairs(word_codes(words)) if len(words) > 1 else ids[:0], [size]])
        weight = np.concatenate([weight, np.ones(len(ids) - len(weight))])
        kept, inverse = np.unique(ids, return_inverse=True)
        examples.append((kept.astype(np.int32), (np.bincount(inverse, weight) / weight.sum()).astype(np.float32), y))
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, weight, y = examples[i]
            hidden = weight @ vectors[ids]
            p = np.exp(out @ hidden - np.max(out @ hidden))
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            back = p @ out
            out -= step * np.outer(p, hidden)
            # each feature's share of the mean is small; the step is scaled to the document's spread as a whole
            vectors[ids] -= (step * weight / max(float(weight @ weight), 1e-3))[:, None] * back * 0.05
            done += 1
    gain = vectors.astype(np.float64) @ (out[1] - out[0]).astype(np.float64)
    return Model(gain[:-1], float(gain[-1]))


def score(docs: DataFrame, model: Model, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text; null or empty texts score by the constant feature alone."""
    gain, always = model.gain, model.always

    def compute(words: list[bytes]) -> tuple[np.ndarray, ...]:
        ids, owner = features(_marked(words), BITS, GRAMS)
        return np.bincount(owner, gain[ids], len(words)), np.bincount(owner, minlength=len(words)).astype(float), word_codes(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(compute)
        for batch in batches:
            for part in slices(batch):
                words = [(t or b"").split() for t in part.column(2).to_pylist()]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                total, number = np.full(len(words), always), np.ones(len(words))
                if lengths.sum():
                    at = known.rows(list(chain.from_iterable(words)))
                    value, count, codes = (x[at] for x in known.arrays)
                    total += sums(value, lengths)
                    number += sums(count, lengths)
                    inner = np.ones(len(at), bool)  # a pair starts at every word but a document's last
                    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
                    pair = np.zeros(len(at))
                    pair[:-1][inner[:-1]] = gain[_pairs(codes)[inner[:-1]]]
                    total += sums(pair, lengths)
                    number += np.maximum(lengths - 1, 0)
                p = 1 / (1 + np.exp(-np.clip(total / number, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", mod) == held).alias("held_out"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.3, seed: int = 42) -> DataFrame:
    """Fits on at most most_rows labelled documents outside the held-out fifth and scores all documents.

    Without any labelled row every score is 0.5. A null doc_id keeps its row, held_out null. Repeated rows stay; an empty table gives
    none; other columns are ignored.
    """
    return score(docs, train(labelled_sample(docs, labels, "quality", 5, 0, most_rows, seed), seed=seed), threshold=threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
