"""SimHash near-duplicates by segment bit counts and a grid join under Manhattan distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.llm.common import components, settled, slices, split_words, table

SEED = 42
#: Low bit of each two-bit segment of a 64-bit word.
LOW_BITS = 0x5555555555555555


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined k-word shingles, repeats included; fewer than k words: of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, high bit first: a bit is 1 if it is set in over half the hashes; none: all zero."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of each row's whole text; a null text is an empty one, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [
                    int.from_bytes(majority(shingle_hashes(split_words(t or b""), shingle, seed)), "big", signed=True)
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _unit_moves() -> str:
    """SQL: the embedding's own grid point and those one step away.

    Two bits hold each segment's count of 0, 1 or 2: xor 1 steps between 0 and 1, xor 3 between 1 and 2.
    """
    steps = "transform(sequence(0, 62, 2), i -> {})"
    by_one = steps.format("if((shiftrightunsigned(cell, i) & 2L) = 0L, cell ^ shiftleft(1L, i), null)")
    by_three = steps.format("if((shiftrightunsigned(cell, i) & 3L) <> 0L, cell ^ shiftleft(3L, i), null)")
    return f"concat(array(cell), filter(concat({by_one}, {by_three}), x -> x is not null))"


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` whose Hamming distance is at most max_bits (0, 1 or 2).

    Embedding: the bit counts of 32 two-bit segments. Their Manhattan distance never exceeds the Hamming
    distance, so fingerprints within 2 bits lie within 2 grid steps and share a grid point one step from
    both; each fingerprint is filed under its own point and the (at most 64) points a step away, and
    fingerprints that meet are verified bit by bit.
    A point with over `crowd` fingerprints gives no pairs: its fingerprints are filed under themselves and their
    64 one-bit changes, where two meet only if they differ in at most 2 bits, and each file links to its
    smallest: the components are the same, the rows linear. For max_bits 1 a file is a fingerprint without one bit.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    cell = f"((fp & {LOW_BITS}L) ^ (shiftrightunsigned(fp, 1) & {LOW_BITS}L)) | shiftleft(fp & shiftrightunsigned(fp, 1) & {LOW_BITS}L, 1)"
    filed = fps.select("fp", F.expr(cell).alias("cell")).select("fp", F.expr(f"explode({_unit_moves()})").alias("point"))
    met = settled(filed.withColumn("n", F.count("*").over(Window.partitionBy("point"))).where("n > 1"))
    few = met.where(F.col("n") <= crowd)
    pairs = (
        few.select("point", F.col("fp").alias("a"))
        .join(few.select("point", F.col("fp").alias("b")), "point")
        .where(f"a < b and bit_count(a ^ b) <= {max_bits}")
        .select("a", "b")
    )
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    if max_bits == 2:  # two that differ in two bits meet one bit from each
        files = "concat(array(struct(-1 as bit, fp as v)), transform(sequence(0, 63), i -> struct(-1 as bit, fp ^ shiftleft(1L, i) as v)))"
    elif max_bits == 1:  # two that differ in bit i are the same without it
        files = "transform(sequence(0, 63), i -> struct(i as bit, fp & ~shiftleft(1L, i) as v))"
    else:
        files = "array(struct(-1 as bit, fp as v))"
    near = many.select("fp", F.expr(f"explode({files})").alias("file"))
    head = near.groupBy("file").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("file", "a")
    stars = near.join(head, "file").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = SEED) -> DataFrame:
    """Each row's fingerprint and component: (doc_id, fingerprint, component_id).

    Fingerprints within max_bits are linked; component_id is the smallest doc_id that links reach, the row's
    own included. Null or empty texts have fingerprint zero and link like any other. A null doc_id keeps
    its row and is passed over by the minimum: component_id is null only if no row of the component has an id.
    Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    prints = settled(fingerprints(docs, shingle, seed))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = settled(components(links(prints.select("fp").distinct(), max_bits)))
    linked = own.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(whole, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
