"""I-Match fingerprints: terms in a band of inverse document frequency, hashed in several randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import settled, slices, split_words, table

#: The band: terms that at least RAREST and at most COMMONEST of the documents hold (idf ln 500 down to ln 5).
RAREST, COMMONEST = 1 / 500, 1 / 5
#: EACH subsets at each share of the lexicon: dense ones tell small edits apart, sparse ones survive large edits. A subset says most of a text
#: of which it holds about one term, so shares go down to where that is so for long texts.
EACH, ENOUGH = 6, 12
SHARES = tuple(2.0**-i for i in range(1, 11) for _ in range(EACH))
FLUSH_TERMS = 150_000


def _count(docs: DataFrame, keep: Callable[[Counter, int], list[tuple[bytes, int]]], only: frozenset[bytes] | None = None) -> DataFrame:
    """(term, df) of the terms that `keep` leaves of each chunk of documents, and with term null its number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            kept = keep(seen, n)
            out = pa.RecordBatch.from_arrays([pa.array([None, *(t for t, _ in kept)], pa.binary()), pa.array([n, *(c for _, c in kept)], pa.int64())], ["term", "df"])
            seen.clear()
            n = 0
            return out

        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    terms = set(split_words(t or b""))
                    seen.update(terms if only is None else terms & only)
                    n += 1
                if len(seen) > FLUSH_TERMS:
                    yield flush()
        if n:
            yield flush()

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> list[bytes]:
    """The band's terms in order, from exact document frequencies over all documents: at most 1 / rarest times the mean number of distinct terms.

    First each chunk names the terms that rarest / 2 of its documents hold. A term that rarest of all hold must have been named for at least
    half its documents, so what was named for rarest / 2 of all documents is all that need be counted: at most 2 / rarest times
    the mean number of distinct terms, whatever the size of the corpus. Then those terms are counted exactly.
    """
    named = settled(_count(docs, lambda seen, n: [(t, c) for t, c in seen.items() if c >= rarest / 2 * n]))
    total = named.where("term is null").agg(F.sum("df")).first()[0] or 0
    likely = frozenset(bytes(r.term) for r in named.where("term is not null").where(F.col("df") >= rarest / 2 * total).select("term").collect())
    exact = _count(docs, lambda seen, n: list(seen.items()), likely).where("term is not null")
    band = exact.where((F.col("df") >= rarest * total) & (F.col("df") <= commonest * total))
    return sorted(bytes(r.term) for r in band.select("term").collect())


def _slot(held: bytes) -> int:
    return xxhash.xxh32_intdigest(held) % 0xFFFF + 1


class Prints:
    """Slots of a text: for each lexicon subset the hash of the text's distinct terms in it, in order; 0 if it has none.

    A text without any lexicon term has the hash of all its terms in every slot; an empty one 0.
    """

    def __init__(self, terms: list[bytes], shares: tuple[float, ...] = SHARES, seed: int = 42):
        self.number = {t: i for i, t in enumerate(terms)}
        self.codes = np.array([xxhash.xxh64_intdigest(t, seed) for t in terms], np.uint64)
        self.member = np.zeros((len(terms), len(shares)), bool)
        for j, share in enumerate(shares):  # a column at a time
            draw = np.fromiter((xxhash.xxh64_intdigest(t, seed + 1 + j) for t in terms), np.uint64, len(terms))
            self.member[:, j] = (draw >> np.uint64(11)).astype(np.float64) / 2.0**53 < share
        self.slots = len(shares)

    def of(self, text: bytes) -> list[int]:
        terms = set(split_words(text))
        ids = np.array(sorted(filter(lambda x: x is not None, map(self.number.get, terms))), np.int64)
        if not len(ids):
            return [_slot(b" ".join(sorted(terms))) if terms else 0] * self.slots
        codes = self.codes[ids]
        return [_slot(codes[m].tobytes()) if m.any() else 0 for m in self.member[ids].T]


def text_of(slots: list[int]) -> str:
    return "".join(f"{x:04x}" for x in slots)


def likeness(a: list[int], b: list[int], each: int = EACH, enough: int = ENOUGH) -> float:
    """Of the slots that are filled in either fingerprint the share that agree; 1 for equal fingerprints.

    Slots are taken from the sparsest subsets on, a share of the lexicon at a time, until `enough` are filled: those of about one term agree about as
    often as the texts share terms, while denser ones all differ once a few terms do.
    """
    if a == b:
        return 1.0
    filled = same = 0
    for at in range(len(a) - each, -1, -each):
        for x, y in zip(a[at : at + each], b[at : at + each]):
            filled += bool(x or y)
            same += x == y and x > 0
        if filled >= enough:
            break
    return same / filled


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row's whole text.

    near_next compares with the next document in ascending doc_id (null first, equal ids by a hash of the text; after the last comes the first).
    Documents are dealt out by ranges of doc_id and that hash; only the first and last of each range meet afterwards, so texts are
    shuffled once. Null texts are empty ones. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    prints = Prints(lexicon(docs) if terms is None else terms)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def result(name: int | None, text: str, own: list[int], following: str, after: list[int]) -> tuple:
        changed = edited(text, following).encode()
        new = prints.of(changed)
        return name, len(text), hashlib.sha256(changed).hexdigest(), text_of(own), text_of(new), likeness(own, new), likeness(own, after)

    def batch_of(rows: list[tuple], part: int, edge: str | None) -> pa.RecordBatch:
        columns = list(zip(*rows))
        if edge is None:
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            more = [pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.string())]
        else:
            arrays = [pa.array(columns[0], pa.int64()), *(pa.nulls(len(rows), t) for t in kinds[1:])]
            more = [pa.array([edge] * len(rows)), pa.array(columns[1])]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32()), *more], [*names, "part", "edge", "text"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part_id = None, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                out = []
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = t or b""
                    here = (name, t.decode("utf-8", "replace"), prints.of(t))
                    if last is None:
                        yield batch_of([here], part_id, "first")
                    else:
                        out.append(result(*last, *here[1:]))
                    last = here
                if out:
                    yield batch_of(out, part_id, None)
        if last is not None:
            yield batch_of([last], part_id, "last")

    h = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"), h.alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    done = settled(dealt.select("doc_id", "t").mapInArrow(run, f"{RESULT}, part int, edge string, text string"))
    edges = done.where("edge is not null")
    parts = sorted(r.part for r in edges.select("part").distinct().collect())  # a number a range
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    ends = edges.where("edge = 'last'").select("part", "doc_id", "text").join(following, "part")
    heads = edges.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("head"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [result(r["doc_id"], r["text"], prints.of(r["text"].encode()), r["head"], prints.of(r["head"].encode())) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    closed = ends.join(heads, "following").select("doc_id", "text", "head").mapInArrow(close, RESULT)
    return done.where("edge is null").select(*names).union(closed)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
