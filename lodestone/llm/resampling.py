"""Importance resampling towards a target: hashed n-gram counts of both sides, long texts cut into overlapping chunks, seeded Gumbel draws."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import settled, slices, table
from lodestone.llm.hashing import WordTable, sums
from lodestone.operators.ordered import placed

BUCKETS = 10_000
LONGEST = 2
#: Texts of more bytes are cut into chunks of about so many.
CHUNK = 1 << 16
#: Words of so many bytes or more are appended one by one rather than by table.
LONG_WORD = 64

#: A-Z to a-z, and what is not in a word to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


#: A word of a text through WORD_BYTES.
A_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(WORD_BYTES).split()


def _appended() -> np.ndarray:
    """[length, byte place, byte]: what the byte of a crc32 becomes when so many bytes follow; the parts and the crc32 of what follows add by xor."""
    out = np.zeros((LONG_WORD + 1, 4, 256), np.uint32)
    for n in range(LONG_WORD + 1):
        none = zlib.crc32(bytes(n), 0)
        bit = [zlib.crc32(bytes(n), 1 << i) ^ none for i in range(32)]
        for place in range(4):
            for i in range(8):
                out[n, place, 1 << i : 2 << i] = out[n, place, : 1 << i] ^ bit[8 * place + i]
    return out


class Grams:
    """crc32 buckets of runs of 1 to `longest` words, joined by a space; what belongs to a word is worked out once while the word is held."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.appended = _appended().ravel()

        def compute(new: list[bytes]) -> tuple[np.ndarray, ...]:
            crc = np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
            after = np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new))
            return crc, after, np.fromiter((min(len(w) + 1, LONG_WORD + 1) for w in new), np.int32, len(new))

        self.table = WordTable(compute)

    def of(self, own: Sequence[list[bytes]], carry: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all runs that start at an own word, own words first in each text's order, and the number of each text.

        A run goes on into the carried words; it ends where the text does.
        """
        words = [w for a, b in zip(own, carry) for w in (*a, *b)]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.table.rows(words)
        crc, after, length = (x[at] for x in self.table.arrays)
        mine = np.array([len(a) for a in own])
        total = mine + np.array([len(b) for b in carry])
        start = np.cumsum(total) - total
        text = np.repeat(np.arange(len(own)), mine)
        place = np.arange(len(text)) - np.repeat(np.cumsum(mine) - mine, mine) + start[text]
        end = (start + total)[text]
        found, owner = [crc[place] % self.buckets], [text]
        now = crc[place]
        for n in range(1, self.longest):
            going = place + n < end
            place, end, text, now = place[going], end[going], text[going], now[going]
            nxt = place + n
            size = np.minimum(length[nxt], LONG_WORD)
            key = size * 1024
            more = after[nxt].copy()
            for b in range(4):
                more ^= self.appended[key + 256 * b + ((now >> np.uint32(8 * b)) & np.uint32(255)).astype(np.int64)]
            for i in np.flatnonzero(length[nxt] > LONG_WORD):
                more[i] = zlib.crc32(b" " + words[nxt[i]], int(now[i]))
            now = more
            found.append(now % self.buckets)
            owner.append(text)
        return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def cut(text: bytes, size: int, carried: int) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of about `size` bytes, parted between words, each with the next `carried` words: (own, carry)."""
    plain = text.translate(WORD_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        carry = [m[0] for m in islice(A_WORD.finditer(plain, end), carried)]
        yield plain[at:end], b" ".join(carry)
        at = end


def long_chunks(docs: DataFrame, size: int = CHUNK, longest: int = LONGEST) -> DataFrame:
    """(row, piece, doc_id, own, carry) of the texts of more than `size` bytes; row tells texts apart. Settle it: rows are numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 8):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for n, (own, carry) in enumerate(cut(text, size, longest - 1)):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, n, name, own, carry), types)], names)
                    row += 1

    names, types = ["row", "piece", "doc_id", "own", "carry"], (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    rows = docs.where(F.octet_length("text") > size).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "row long, piece int, doc_id long, own binary, carry binary")


def _pieces(docs: DataFrame, chunks: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, own, carry) of short texts, whole where they lie, without a row; and of the chunks of long ones, dealt over tasks."""
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= size)
    none = F.lit(None)
    short = short.select(none.cast("long").alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("own"), none.cast("binary").alias("carry"))
    return short, chunks.repartition("row", "piece").select("row", "doc_id", "own", "carry")


def bucket_counts(pieces: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of (own, carry) lie in each bucket; a task gives at most a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                found, _ = grams.of(*([words_of(t or b"") for t in part.column(c).to_pylist()] for c in (0, 1)))
                held += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[own])], ["bucket", "n"])

    found = pieces.select("own", "carry").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """A bucket's floored thousandths of the log of its share in the target over its share in the source, each count one more."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())]


def weigh(pieces: DataFrame, gain: Sequence[int], longest: int = LONGEST) -> DataFrame:
    """(row, doc_id, n_words, n_features, total): a piece's own words, its features and the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grams = np.array(gain, np.int64), Grams(longest, len(gain))
        for batch in batches:
            for part in slices(batch):
                own, carry = ([words_of(t or b"") for t in part.column(c).to_pylist()] for c in (2, 3))
                found, owner = grams.of(own, carry)
                order = np.argsort(owner, kind="stable")
                n = np.bincount(owner, minlength=len(own))
                total = sums(of[found[order]], n).astype(np.int64)  # below 2^53: thousands times the features of a piece
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(w) for w in own], pa.int64()), pa.array(n, pa.int64()), pa.array(total)], names)

    names = ["row", "doc_id", "n_words", "n_features", "total"]
    return pieces.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, total long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text): rank counts the `share` percent of the rows with
    at least `least_words` words that have the highest scores, ties to smaller doc_id, null last; it is null for all others.

    A feature is a run of 1 to `longest` words, repeats counted, and its bucket its crc32 modulo `buckets`. weight is the floored mean of
    the features' gains (see `gains`), score that plus a seeded Gumbel number in thousandths, so ranking draws without replacement in
    proportion to exp(weight / 1000). A null text has no words: weight 0. Null doc_id: its digest is that of the empty id. Rows that
    repeat a doc_id are drawn each by itself. An empty target counts nothing anywhere. Empty docs: no rows. Other columns are left out.

    Texts of over `chunk` bytes are cut at word boundaries into chunks that carry the next words along and own the runs that start in them; chunks
    are dealt over tasks, and their counts and sums added up by text.
    """
    docs, target = docs.select("doc_id", "text"), target.select(F.lit(0).alias("doc_id"), "text")
    short, long = _pieces(docs, settled(long_chunks(docs, chunk, longest)), chunk)
    source = bucket_counts(short.union(long), buckets, longest)
    wanted = bucket_counts(DataFrame.union(*_pieces(target, settled(long_chunks(target, chunk, longest)), chunk)), buckets, longest)
    gain, parts = gains(source, wanted), ("n_words", "n_features", "total")
    summed = weigh(long, gain, longest).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in parts))
    rows = weigh(short, gain, longest).select("doc_id", *parts).union(summed.select("doc_id", *parts))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = F.col("n_words") >= least_words
    rows = settled(rows.select("doc_id", able.alias("able"), "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel))
    drawn = share * rows.where("able").count() // 100
    ranked = placed(rows, [], [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"])
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place").cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
