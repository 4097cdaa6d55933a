"""What several corpus operators share: settled tables, byte-wise word rules, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import components
from lodestone.sources.scratch import release, settled

__all__ = ["LOWER", "NOT_SPACE", "apart", "components", "crc_mod", "discard", "from_planes", "hot_keys", "joined_apart", "planes", "release", "settled", "slices", "split_words", "table"]

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z, for bytes.translate.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the column's decimal text mod n; null stays null."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string")) % n


def split_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at just those bytes."""
    return text.translate(LOWER).split()


def slices(batch, rows: int = 256) -> Iterator:
    """A record batch in small slices, so that few Python objects live at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, the first of all, then the second of all, and so on: what the high ones have in common compresses to nothing."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def from_planes(packed: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again; what was made of them must be settled by then."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for at in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: A value is hot if it has this share of all rows or more, so at most HOT values are: rows of those can be broadcast.
HOT = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key) of the values that a thousandth of all rows or more have."""
    per = settled(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = per.agg(F.sum("n")).first()[0] or 0
    return settled(per.where(F.col("n") * HOT >= total).select(key))


def apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled rows of all other keys, rows of hot keys, and the hot keys: for tables that are joined by the key several times."""
    hot = hot_keys(df, key)
    return settled(df.join(F.broadcast(hot), key, "left_anti")), settled(df.join(F.broadcast(hot), key, "left_semi")), hot


def joined_apart(left: DataFrame | tuple[DataFrame, DataFrame, DataFrame], right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has a key once, whatever part of left has one key: rows of hot keys stay where they are, the others are
    shuffled. left is read several times, or given as `apart` has parted it."""
    if isinstance(left, DataFrame):
        hot = F.broadcast(hot_keys(left, key))
        left = left.join(hot, key, "left_anti"), left, hot
    cold, warm, hot = left
    return cold.join(right.hint("merge"), key).unionByName(warm.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key))
