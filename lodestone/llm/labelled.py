"""Bounded, seeded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod

#: Longest text, in bytes, of which a sample takes in the whole; of longer ones it takes a seeded window of so many characters.
WINDOW_CHARS = 1 << 14


def window(text: Column, seed: int, chars: int) -> Column:
    """The whole text if it has at most so many characters, else that many from a seeded place."""
    at = F.pmod(F.xxhash64(F.lit(seed), text), F.greatest(F.length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    return F.substring(text, at, F.lit(chars))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, seed: int = 42, chars: int = WINDOW_CHARS) -> list[tuple[bytes, int]]:
    """At most `most` (text, label) rows for fitting, by a seeded hash, from documents whose crc32(doc_id) mod `mod` is not `held`.

    The sample is drawn from the small label columns; at most `most` ids are sent to where the texts are. A label row without
    a document gives nothing; a document or label that repeats counts as often, within the bound.
    """
    named = labels.where(F.col(label).isin(0, 1)).where(crc_mod("doc_id", mod) != held)
    drawn = named.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(seed), "k"), "k", "y").limit(most)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("k"))
    rows = found.select(window(text, seed, chars).cast("binary").alias("t"), "y", F.xxhash64(F.lit(seed), "k", text).alias("h")).orderBy("h", "y", "t").limit(most)
    got = rows.toArrow()
    return list(zip(got.column("t").to_pylist(), got.column("y").to_pylist()))
