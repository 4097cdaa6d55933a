"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared window by window."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, slices, split_words, table
from lodestone.llm.labelled import labelled_sample

#: Rows that the dictionaries and thresholds are fitted on, at most.
MOST_ROWS = 6000
#: Words of a window, and from one window's start to the next.
WORDS, STRIDE = 4, 2
#: Bytes of the dictionaries: of ordinary text, of all toxic text, and of the toxic windows that come again.
ORDINARY_BYTES, BROAD_BYTES, TOXIC_BYTES = 49_152, 8192, 4096
#: A saving tells if it is so many times as frequent in toxic windows as in ordinary ones.
RATIO = 6.0
#: What ends every window: bytes that both dictionaries hold, as zstandard begins no match in an input's last eight bytes.
AFTER = b" the of and in "
STEPS = (2, 4, 6)


def windows(words: list[bytes], number: int = WORDS, stride: int = STRIDE) -> list[bytes]:
    """Runs of words of the text, each overlapping the next; none for a text without words."""
    last = max(1, len(words) - number + stride) if words else 0
    return [b" %b%b" % (b" ".join(words[i : i + number]), AFTER) for i in range(0, last, stride)]


def _words(window: bytes) -> list[bytes]:
    return window[: -len(AFTER)].split()


def _compress(content: bytes) -> Callable[[bytes], bytes]:
    """Raw content, so that a window's length counts literal bytes and matches and nothing else."""
    quick = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, target_length=8,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=quick).compress


def dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """The content that zstandard's trainer picks from the samples, its tables left out; of too little text, all of it."""
    held = [b" %b " % b" ".join(w) for w in map(_words, samples) if sum(map(len, w)) > 7]
    try:
        return zstandard.train_dictionary(size + 1024, held, **cover).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(held)[-size:]


def _shares(gains: np.ndarray) -> np.ndarray:
    """Of each saving from 0 to 15 bytes the share of windows that save as much or more."""
    return (gains[:, None] >= np.arange(16)).mean(0) if len(gains) else np.zeros(16)


@dataclass
class Model:
    """The dictionaries' contents, and a logistic curve over how many windows pass each threshold and how many there are."""

    toxic: bytes
    ordinary: bytes
    curve: np.ndarray
    rate: float

    def gains(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function of a text's words: by how many bytes each window is shorter with the toxic dictionary than without.

        The ordinary content stands behind the toxic one in its compressor too, so what both know costs both the same.
        """
        plain, toxic = _compress(self.ordinary), _compress(self.toxic + self.ordinary)

        def of(words: list[bytes]) -> np.ndarray:
            held = windows(words)
            return np.fromiter((len(plain(w)) - len(toxic(w)) for w in held), np.int64, len(held))

        return of

    def score(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(lengths), self.rate)
        return 1 / (1 + np.exp(-np.clip(_inputs(counts, lengths) @ self.curve, -500, 500)))


def passed(gains: np.ndarray) -> list[int]:
    """How many windows save each of STEPS or more."""
    return [int((gains >= s).sum()) for s in STEPS]


def _inputs(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    many = lengths[:, None]
    return np.concatenate([np.ones((len(lengths), 1)), np.log1p(counts), np.log((counts + 0.05) / (many + 20)), np.log1p(many)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def recurring(own: list[bytes], other: list[bytes], apart: list[bytes], ordinary: bytes) -> list[bytes]:
    """Of toxic windows those that a dictionary of other toxic documents shortens, cut to the two words it shortens most.

    What it saves must be RATIO times as frequent here as in the ordinary windows kept apart; so only what comes again in toxic text, and not
    in ordinary text, is left.
    """
    plain, toxic = _compress(ordinary), _compress(dictionary(other, BROAD_BYTES, k=24, d=8) + ordinary)

    def save(w: bytes) -> int:
        return len(plain(w)) - len(toxic(w))

    gains, rest = (np.fromiter(map(save, x), np.int64, len(x)) for x in (own, apart))
    telling = np.flatnonzero(_shares(gains)[1:] >= RATIO * _shares(rest)[1:])
    least = telling[0] + 1 if len(telling) else 16
    return [max(windows(_words(own[i]), 2, 1), key=save) for i in np.flatnonzero(gains >= least)]


def train(rows: list[tuple[bytes, int]], seed: int = 42) -> Model:
    """The ordinary dictionary is trained on windows of a third of the ordinary documents. Two halves of three quarters of the toxic
    documents choose the other's recurring windows, which the toxic dictionary is trained on; a second third of the ordinary ones
    sets the bar for that. The rest, which no dictionary has seen, calibrates the thresholds. Without both labels, or with too few rows, every score
    is the share of label 1."""
    rate = sum(y for _, y in rows) / len(rows) if rows else 0.0
    flat = Model(b"", b"", np.zeros(0), rate)
    rng = random.Random(seed)
    split = [(split_words(t), y) for t, y in rows]
    rng.shuffle(split)
    toxic, ordinary = ([w for w, y in split if y == label] for label in (1, 0))
    if len(toxic) < 8 or len(ordinary) < 9:
        return flat

    def all_of(documents: list[list[bytes]]) -> list[bytes]:
        return [w for words in documents for w in windows(words)]

    kept = toxic[::4]
    halves = [all_of([w for i, w in enumerate(toxic) if i % 4 and i % 2 == h]) for h in (0, 1)]
    third = len(ordinary) // 3
    seen, apart = all_of(ordinary[:third]), all_of(ordinary[third : 2 * third])
    if not seen or not apart or not all(halves):
        return flat
    plain = dictionary(rng.sample(seen, min(len(seen), 60_000)), ORDINARY_BYTES) + AFTER
    apart = rng.sample(apart, min(len(apart), 60_000))
    chosen = [w for h in (0, 1) for w in recurring(halves[h], halves[1 - h], apart, plain)]
    if not chosen:
        return flat
    model = Model(dictionary(chosen, TOXIC_BYTES, k=24, d=8), plain, np.zeros(0), rate)
    gains = model.gains()
    measured = [(gains(words), y) for y, held in ((1, kept), (0, ordinary[2 * third :])) for words in held]
    counts, lengths = np.array([passed(g) for g, _ in measured], float), np.array([len(g) for g, _ in measured], float)
    model.curve = _logistic(_inputs(counts, lengths), np.array([y for _, y in measured], float))
    return model


def score(docs: DataFrame, model: Model, mod: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text; null or empty texts score by the curve without windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains() if len(model.curve) else lambda words: np.zeros(0)
        for batch in batches:
            for part in slices(batch):
                counts, lengths = np.zeros((part.num_rows, len(STEPS))), np.zeros(part.num_rows)
                for i, t in enumerate(part.column(2).to_pylist()):
                    saved = gains(split_words(t or b""))
                    counts[i], lengths[i] = passed(saved), len(saved)
                p = model.score(counts, lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", mod) == held).alias("held_out"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.7, seed: int = 42) -> DataFrame:
    """Fits on at most most_rows labelled documents outside the held-out third and scores all documents.

    A null doc_id keeps its row, held_out null. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    return score(docs, train(labelled_sample(docs, labels, "toxic", 3, 1, most_rows, seed), seed), threshold=threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
