"""Groups of documents alike in their five-word shingles, found by an exact prefix filter on the shingles and verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, from_planes, planes, settled, slices, split_words
from lodestone.llm.simhash import shingle_hashes

PLACES = 1 << 24  # of the table of common shingles
FLUSH = 1 << 21  # shingles of a chunk of texts
PART_ENTRIES = 1 << 19  # entries that a part of the cells has on average at most
MARKS = 1 << 23  # bits of a filter for rows
#: Pairs of all cells are compared once they are no more than so many times the cells' rows.
DENSE = 8


def _distinct(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct XXH64 of the k-word shingles."""
    return np.unique(shingle_hashes(split_words(text or b""), k))


def _least(x: float) -> int:
    return math.ceil(x - 1e-9)


def common_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """A byte for each place of the leading 24 bits of a shingle's hash: the bits of the highest count of texts there, 0 where none
    repeats in a chunk of texts; and the number of shingles.

    Each chunk of about two million shingles names those that several of its texts hold; their counts add up. A shingle in 1/1000 of
    all texts is named by nearly every chunk. The table only orders shingles: what it misses, and collisions, cost time, not results.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = set()
        total = n = 0

        def flush() -> pa.RecordBatch:
            ids, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            ids, many = ids[many > 1], many[many > 1]
            held.clear(), seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(many)], ["id", "n"])

        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    mark = hash(t)
                    if mark in seen:  # a text that comes again in the chunk says nothing about its shingles
                        continue
                    seen.add(mark)
                    held.append(_distinct(t, k))
                    n += len(held[-1])
                    total += len(held[-1])
                    if n >= FLUSH:
                        yield flush()
                        n = 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["id", "n"])

    found = rows.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "id long, n long")
    place = F.shiftrightunsigned("id", 40).cast("int")
    best = settled(found.groupBy("id").agg(F.sum("n").alias("n")).groupBy(place.alias("place")).agg(F.max("n").alias("n")))
    out = np.zeros(PLACES, np.uint8)
    got = best.where("place is not null").select("place", F.ceil(F.log2("n")).cast("int").alias("bits")).toArrow()  # at most PLACES rows
    out[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    total = best.where("place is null").agg(F.sum("n")).first()[0] or 0
    discard(best)
    return out, total


PRINTS = "part int, row long, doc_id long, same binary, h long, size int, blob binary"


def prefixes(rows: DataFrame, least: float, k: int) -> tuple[DataFrame, int]:
    """Of each row (row, doc_id, same binary, h, size): a digest of the words in order, 64 bits of it, and the number of distinct shingles;
    and rows (part, blob) with the texts' rarest shingles, dealt into parts by hash, a chunk of texts at a time.

    A text's prefix is as long as it takes that no text with a similarity of `least` lacks it wholly. A blob has a chunk's distinct texts (h,
    size), and in the order of shingles, of each entry its shingle, its text's place and its place in the text's prefix.
    """
    common, total = common_shingles(rows, k)
    common = zstandard.compress(common.tobytes(), 1)  # most places are 0
    bits = max(0, math.ceil(math.log2(max(1, (1 - least) * total / PART_ENTRIES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(zstandard.decompress(common), np.uint8)
        texts: dict[int, int] = {}
        sizes: list[int] = []
        found: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate([np.zeros(0, np.uint64), *found])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            text = np.repeat(np.arange(len(found), dtype=np.uint32), lengths)
            nth = (np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            key, text, nth = key[order], text[order], nth[order]
            h, size = np.fromiter(texts, np.uint64, len(texts)), np.array(sizes, np.uint32)
            part = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
            own, starts = np.unique(part, return_index=True)
            blobs = []
            for a, b in zip(starts, [*starts[1:], len(key)]):
                used, local = np.unique(text[a:b], return_inverse=True)
                parts = [planes(x) for x in (h[used], size[used], key[a:b], local.astype(np.uint32), nth[a:b])]
                blobs.append(b"".join([np.array([len(p) for p in parts], "<u4").tobytes(), *parts]))
            texts.clear(), sizes.clear(), found.clear()
            nulls = [pa.nulls(len(own), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *nulls, pa.array(blobs, pa.binary())], names)

        for batch in batches:
            for part in slices(batch):
                same, hs, counted = [], [], []
                for t in part.column(2).to_pylist():
                    words = split_words(t or b"")
                    joined = b" ".join(words)
                    h = xxhash.xxh3_64_intdigest(joined)
                    same.append(xxhash.xxh3_128_digest(joined))
                    hs.append(h)
                    if h in texts:
                        counted.append(sizes[texts[h]])
                        continue
                    keys = np.unique(shingle_hashes(words, k))
                    rank = ranks[keys >> np.uint64(40)]
                    if rank.any():
                        keys = keys[np.argsort(rank, kind="stable")]
                    texts[h] = len(texts)
                    sizes.append(len(keys))
                    counted.append(len(keys))
                    found.append(keys[: len(keys) - _least(least * len(keys)) + 1])
                    n += len(found[-1])
                none = pa.nulls(len(same), pa.int32()), pa.nulls(len(same), pa.binary())
                h = pa.array(np.array(hs, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([none[0], part.column(0), part.column(1), pa.array(same, pa.binary()), h, pa.array(counted, pa.int32()), none[1]], names)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    names = [c.split()[0] for c in PRINTS.split(", ")]
    prints = rows.select("row", F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, PRINTS)
    return prints, bits


def shingle_sets(rows: DataFrame, marks: np.ndarray, k: int = 5) -> DataFrame:
    """(row, shingles binary) of rows whose mark is set: the sorted distinct leading 48 bits of the XXH64 of the k-word shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(_among(marks, batch.column(2)))):
                packed = [planes(np.unique(_distinct(t, k) >> np.uint64(16))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["row", "shingles"])

    return rows.select("row", F.col("text").cast("binary").alias("t"), _place("row")).mapInArrow(run, "row long, shingles binary")


def _place(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(MARKS)).cast("int").alias("place")


def marked(rows: DataFrame, row: str = "row") -> np.ndarray:
    """A filter of MARKS bits: whether some row has the place. What it lets through besides costs time, not results."""
    out = np.zeros(MARKS, bool)
    out[rows.select(_place(row)).distinct().toArrow().column("place").to_numpy()] = True  # at most MARKS rows
    return np.packbits(out)


def _among(marks: np.ndarray, places: pa.Array) -> pa.Array:
    at = places.to_numpy()
    return pa.array((marks[at >> 3] >> (7 - (at & 7))) & 1 == 1)


def only(df: DataFrame, marks: np.ndarray) -> DataFrame:
    """The rows of (row, shingles) whose mark is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(_among(marks, batch.column(2)))

    return df.select("row", "shingles", _place("row")).mapInArrow(run, "row long, shingles binary")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = from_planes(x, "<u8"), from_planes(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    marks = marked(pairs.select("a").union(pairs.select("b")), "a")
    sets = only(sets, marks)
    one = lambda name: sets.select(F.col("row").alias(name), F.col("shingles").alias(f"s{name}"))
    # neither side has a size bound: no broadcast, whatever the sizes of the day
    return pairs.join(one("a").hint("merge"), "a").join(one("b").hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _needed(size: Column, share: float) -> Column:
    return F.ceil(size * F.lit(share) - F.lit(1e-9))


def cells(prints: DataFrame, least: float) -> DataFrame:
    """(cell, h, nth, size, leads) of the texts in each cell, a shingle, where two can be alike; cells of the same texts are one.

    Two alike texts have their first common shingle, in the order of prefixes, in the longer one's prefix, and in the shorter one's so
    early that 2 `least` / (1 + `least`) of it can still follow: there it leads. Cells of one text, or without one that leads, go. A cell is named by
    its texts; of several with the same texts each text keeps its earliest place, so that no pair is passed over.
    """
    share = 2 * least / (1 + least)

    def meet(group: pa.Table) -> pa.Table:
        columns = []
        for blob in group.column("blob").to_pylist():
            cuts = np.cumsum(np.frombuffer(blob, "<u4", 5)) + 20
            parts = [blob[a:b] for a, b in zip([20, *cuts[:-1]], cuts)]
            h, size, key, text, nth = (from_planes(p, t) for p, t in zip(parts, ("<u8", "<u4", "<u8", "<u4", "<u4")))
            columns.append((key, h[text], nth, size[text]))
        key, h, nth, size = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((h, key))
        key, h, nth, size = key[order], h[order], nth[order].astype(np.int64), size[order].astype(np.int64)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])  # a text from several chunks
        key, h, nth, size = key[first], h[first], nth[first], size[first]
        leads = nth <= size - np.ceil(size * share - 1e-9)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(starts, len(key)))
        good = (many > 1) & np.maximum.reduceat(leads, starts)
        found: dict[int, list] = {}
        for a, m in zip(starts[good], many[good]):
            own = slice(a, a + m)
            name = xxhash.xxh3_64_intdigest(h[own].tobytes())
            if name in found:
                np.minimum(found[name][1], nth[own], out=found[name][1])
                np.maximum(found[name][3], leads[own], out=found[name][3])
            else:
                found[name] = [h[own], nth[own].copy(), size[own], leads[own].copy()]
        names = np.repeat(np.fromiter(found, np.uint64, len(found)), [len(x[0]) for x in found.values()]) if found else np.zeros(0, np.uint64)
        h, nth, size, leads = (np.concatenate(c) for c in zip(*found.values())) if found else (names, names, names, names.astype(bool))
        return pa.table([names.view(np.int64), h.view(np.int64), nth.astype(np.int32), size.astype(np.int32), leads], ["cell", "h", "nth", "size", "leads"])

    dealt = prints.where("part is not null").select("part", "blob").groupBy("part")
    met = dealt.applyInArrow(meet, "cell long, h long, nth int, size int, leads boolean")
    return met.groupBy("cell", "h").agg(F.min("nth").alias("nth"), F.any_value("size").alias("size"), F.max("leads").alias("leads"))


def _meeting(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) of texts of the two sides in a cell, of different groups, that can still have all shingles in common that they need."""
    left = left.select("cell", *(F.col(c).alias(f"l_{c}") for c in ("row", "nth", "size", "root")))
    need = _needed(F.col("size") + F.col("l_size"), least / (1 + least))
    fits = (F.col("root") != F.col("l_root")) & (F.col("size") - F.col("nth") >= need) & (F.col("l_size") - F.col("l_nth") >= need)
    # neither side has a size bound: no broadcast, whatever the sizes of the day
    met = left.hint("merge").join(right.withColumnRenamed("cell", "of"), (F.col("cell") == F.col("of")) & fits)
    return met.select(F.least("row", "l_row").alias("a"), F.greatest("row", "l_row").alias("b"))


def linked(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root) of the texts that chains of alike texts join.

    While the pairs of different groups in cells are many, each cell's texts meet one of them, another each turn; that joins large groups with
    a row a text. In the last turn all pairs that are left in any cell meet: texts outside a cell's largest group with all, so nothing is passed over.
    """
    whole = Window.partitionBy("cell")
    links = tried = roots = None
    before, turn, last = math.inf, 0, False
    while not last:
        if roots is None:
            now = met.withColumn("root", F.col("row"))
        else:
            now = met.join(roots.hint("merge"), met["row"] == roots["node"], "left").withColumn("root", F.coalesce("root", "row")).drop("node")
        now = now.withColumn("low", F.min("root").over(whole)).withColumn("high", F.max("root").over(whole)).where("low <> high")
        main = F.mode("root").over(whole) if roots is not None else F.col("low")
        now = settled(now.withColumn("stray", F.col("root") != main).drop("low", "high"))
        per = now.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays"), F.count_if("leads").alias("led"), F.count_if(F.col("leads") & F.col("stray")).alias("both"))
        rows, pairs = per.agg(F.sum("n"), F.sum(F.expr("both * cast(n as double) + (led - both) * strays"))).first()
        if not rows:
            break
        last = pairs <= DENSE * rows or pairs > 0.95 * before
        before = pairs
        if last:
            led = now.where("leads")
            new = _meeting(led.where("stray"), now, least).union(_meeting(led.where("not stray"), now.where("stray"), least)).distinct()
        else:
            # at first the text with the least that is rare before the cell's shingle: the middle of a family rather than its edge
            place = F.col("nth") if turn % 2 == 0 else F.lit(0)
            one = F.min(F.struct(~F.col("leads"), place.alias("at"), F.xxhash64(*([F.lit(turn), "cell"] if turn else []), "row").alias("h"), "row", "nth", "size", "root")).over(whole)
            head = now.withColumn("head", one)
            need = _needed(F.col("size") + F.col("head.size"), least / (1 + least))
            fits = (F.col("root") != F.col("head.root")) & (F.col("size") - F.col("nth") >= need) & (F.col("head.size") - F.col("head.nth") >= need)
            new = head.where(fits).select(F.least("row", "head.row").alias("a"), F.greatest("row", "head.row").alias("b")).distinct()
        if tried is not None:
            new = new.join(tried.hint("merge"), ["a", "b"], "left_anti")
        new = settled(new)
        tried = new if tried is None else tried.union(new)
        found = settled(alike(new, sets, least))
        links = found if links is None else links.union(found)
        roots = settled(components(links))
        turn += 1
    if roots is None:
        return met.select(F.col("row").alias("node"), F.col("row").alias("root")).limit(0)
    return roots


def near_texts(rows: DataFrame, least: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Settled (row, doc_id, same) of all rows, and (same, first, group) of the distinct texts: the first row (none, doc_id, row) of each, by doc_id
    (null last), then row, and the number of the group that shingle similarities of at least `least` link.
    """
    prints = settled(prefixes(rows, least, shingle)[0])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    texts = settled(prints.where("part is null").groupBy("same").agg(first, F.any_value("h").alias("h")))
    named = texts.select(F.col("first.row").alias("row"), F.col("h").alias("of"))
    filed = cells(prints, least)
    met = settled(filed.join(named.hint("merge"), filed["h"] == named["of"]).select("cell", "row", "nth", "size", "leads"))
    sets = settled(shingle_sets(rows, marked(met), shingle))
    roots = linked(met, sets, least)
    group = F.coalesce("root", "first.row").alias("group")
    grouped = settled(texts.join(roots.hint("merge"), F.col("first.row") == F.col("node"), "left").select("same", "first", group))
    each = settled(prints.where("part is null").select("row", "doc_id", "same"))
    discard(prints, texts, met, sets)
    return each, grouped


def near_firsts(rows: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(row) of the first row, by doc_id (null last), then row, of each group of `near_groups`. Rows that are equal in row, doc_id and text are one."""
    _, texts = near_texts(rows, least, shingle)
    return texts.groupBy("group").agg(F.min("first").alias("first")).select("first.row")


def near_groups(rows: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(row, group, keep) of rows (row long, unique; doc_id; text): groups linked by shingle similarity of at least `least`; keep marks
    each group's first row by doc_id (null last), then row.

    Equal word sequences are one text from the start. The groups are those of all pairs that are alike (see `cells`, `linked`), up to
    collisions of hashes. Null and empty texts are equal to each other. Empty table: no rows.
    """
    each, texts = near_texts(rows, least, shingle)
    first = texts.groupBy("group").agg(F.min("first").getField("row").alias("least"))
    named = texts.join(first, "group").select(F.col("same").alias("key"), "group", "least")
    return each.join(named, F.col("same") == F.col("key")).select("row", "group", (F.col("row") == F.col("least")).alias("keep"))
