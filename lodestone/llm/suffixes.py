"""Removal of byte strings that an earlier document has, by a Burrows-Wheeler transform of a collection that is built column by column.

What two documents share is found where it meets: each string of `least` bytes goes by its anchor, the least hash of the runs of `anchor` bytes in
it, so equal strings have equal anchors. Neighbours with one anchor make a segment of at most 2 `least` - `anchor` bytes. Segments whose anchor
comes in two documents or more are sent to buckets by anchor, each distinct one of a chunk of documents once, with the least doc_id there. A bucket
builds the transform and the common prefixes of its distinct segments, a symbol of every segment each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, from_planes, planes, settled, slices, table
from lodestone.sources.scratch import bucketed

LEAST, ANCHOR = 50, 24
#: A chunk of documents ends once it has so many bytes, or at so many rows.
CHUNK_BYTES, CHUNK_ROWS = 1 << 23, 1 << 17
#: Anchors that a part of them has on average at most, and bytes of segments that a bucket has.
PART_KEYS, BUCKET_BYTES = 1 << 20, 1 << 22
#: Segments of an anchor that more than so many segments have are cut into single strings, which go by their own hash.
HOT = 1 << 15
#: Strings that are hashed at a time.
BLOCK = 1 << 18
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1


# ---- the transform of one bucket


def range_least(values: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 32) -> np.ndarray:
    """The least of values[start:end] of each pair, none empty; long ranges by way of the least of whole blocks."""
    size = end - start
    out = values[start]
    short = np.flatnonzero((size > 1) & (size <= 4 * block))
    if short.size:
        first = np.cumsum(size[short]) - size[short]
        at = np.arange(int(size[short].sum())) + np.repeat(start[short] - first, size[short])
        out[short] = np.minimum.reduceat(values[at], first)
    long = np.flatnonzero(size > 4 * block)
    if long.size:
        s, e = start[long], end[long]
        a, b = -(-s // block), e // block
        whole = np.minimum.reduceat(values, np.arange(0, len(values), block))
        edges = np.minimum(range_least(values, s, s + block, block), range_least(values, e - block, e, block))
        out[long] = np.minimum(edges, range_least(whole, a, b, block))
    return out


def collection(strings: Sequence[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of all strings, each with an end of its own that is less than every symbol, and the common prefix of each suffix with the one
    before it, up to `least` symbols: round j inserts the suffixes of j symbols, one a string, into what the rounds before have made.

    Both columns are read and written front to back each round, as files would be; a bucket's size is bounded, so they stay in memory.
    Symbols are numbered from 1 in their order; 0 is an end.
    """
    m = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    symbols, flat = np.unique(flat, return_inverse=True)
    flat = (flat + 1).astype(np.uint8 if len(symbols) < 255 else np.uint16)
    ends = np.cumsum(lengths)
    bwt, common = np.zeros(m, flat.dtype), np.zeros(m, np.uint8)
    at = np.arange(m)  # of each string's suffix so far
    who = np.empty(0, np.int64)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = np.flatnonzero(lengths >= j)
        bwt[at[going]] = flat[ends[going] - j]
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")  # by symbol, then place: where each symbol's suffix stands
        ended = m - len(going)
        new = np.zeros(n, bool)
        new[at[going]] = True
        is_new = new[order]
        k = np.flatnonzero(is_new)
        here = order[k]
        if len(who) < n:
            who = np.empty(2 * n, np.int64)
        who[at[going]] = going
        place = k + (m - ended)
        at[who[here]] = place
        # with the one before it of the same symbol a suffix has one symbol more in common than the least of all between them
        before, follows = k[k > 0], k[k + 1 < n]
        before = before[bwt[order[before - 1]] == bwt[order[before]]]
        follows = follows[(bwt[order[follows + 1]] == bwt[order[follows]]) & ~is_new[follows + 1]]
        a, b = order[np.concatenate((before - 1, follows))], order[np.concatenate((before, follows + 1))]
        more = np.minimum(range_least(common, a + 1, b + 1), least - 1) + 1
        kept = np.ones(n + len(k), bool)
        kept[place] = False
        grown, prefixes = np.zeros(n + len(k), bwt.dtype), np.zeros(n + len(k), np.uint8)
        grown[kept], prefixes[kept] = bwt, common
        prefixes[before + (m - ended)] = more[: len(before)]
        prefixes[follows + (m - ended + 1)] = more[len(before) :]
        bwt, common = grown, prefixes
    return bwt, common


def classes(strings: Sequence[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of `least` symbols, strings in order and starts ascending, equal for equal runs; and where each string's begin."""
    m = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    first = np.concatenate(([0], np.cumsum(np.maximum(lengths - least + 1, 0))))
    bwt, common = collection(strings, least)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))  # the m ends come first, as the m empty suffixes do
    number = np.cumsum(common < least)
    out = np.empty(first[-1], np.int64)
    at = np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = np.flatnonzero(lengths >= j)
        at[going] = step[at[going]]
        if j >= least:
            out[first[going] + lengths[going] - j] = number[at[going]]
    return out, first


# ---- anchors and segments of a text


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each run of n bytes, by doubling."""
    part, size, power = data.astype(np.uint64) + np.uint64(1), 1, FACTOR
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out, done = part, size
            else:
                many = max(0, len(data) - done - size + 1)
                out = out[:many] * power + part[done : done + many]
                done += size
        if 2 * size > n:
            return out
        many = max(0, len(part) - size)
        part = part[:many] * power + part[size : size + many]
        size, power = 2 * size, power * power


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(data: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's 40 bits, start, strings) of the segments of a text: neighbouring strings of `least` bytes with one anchor, at most as many as
    an anchor can serve."""
    width = least - anchor + 1
    found = []
    with np.errstate(over="ignore"):
        for at in range(0, len(data) - least + 1, BLOCK):
            own = _sliding_least(_mixed(_grams(data[at : at + BLOCK + least - 1], anchor)), width)
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(edge, len(own)))
            if (size > width).any():  # a text that repeats itself
                pieces = -(-size // width)
                nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                edge = np.repeat(edge, pieces) + nth * width
                size = np.diff(np.append(edge, len(own)))
            found.append((_mixed(own[edge] * FACTOR) >> np.uint64(24), edge + at, size))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _chunk_segments(text: np.ndarray, lengths: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start in the chunk, strings, document) of the segments of documents that follow each other."""
    found = []
    at = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= least:
            key, start, size = segments(text[at : at + n], least, anchor)
            found.append((key, start + at, size, np.full(len(key), i)))
        at += n
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none.astype(np.uint64), none, none, none)


def _distinct(key: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, whether several documents have each, and how many segments."""
    order = np.argsort(key, kind="stable")
    key, document = key[order], document[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    end = np.append(start[1:], len(key))[: len(start)]
    return key[start], document[start] != document[end - 1], end - start


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [planes(x) for x in arrays]
    return b"".join([np.array([len(p) for p in parts], "<u4").tobytes(), *parts])


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    cuts = np.cumsum(np.frombuffer(packed, "<u4", len(kinds))) + 4 * len(kinds)
    return [from_planes(packed[a:b], k) for a, b, k in zip([4 * len(kinds), *cuts[:-1]], cuts, kinds)]


# ---- what chunks, parts and buckets tell each other

CHUNKS = "chunk long, part int, keys binary, names binary, texts binary"


def chunked(docs: DataFrame, bits: int, least: int, anchor: int, chunk_bytes: int) -> DataFrame:
    """Documents in chunks: a row (chunk, names, texts), and rows (chunk, part, keys) with the chunk's anchors, dealt over 2^bits parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        names: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            whole = b"".join(texts)
            key, _, _, document = _chunk_segments(np.frombuffer(whole, np.uint8), lengths, least, anchor)
            key, many, times = _distinct(key, document)
            part = (key >> np.uint64(40 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            own, starts = np.unique(part, return_index=True)
            ends = np.append(starts[1:], len(key))
            packed = [_pack(np.diff(key[a:b], prepend=np.uint64(0)), many[a:b], np.minimum(times[a:b], 1 << 30).astype(np.uint32)) for a, b in zip(starts, ends)]
            named = _pack(np.array(names, np.int64), lengths)
            rows = len(own)
            columns = [pa.array([chunk] * (rows + 1), pa.int64()), pa.array([*own.tolist(), None], pa.int32()), pa.array([*packed, None], pa.binary())]
            columns += [pa.array([None] * rows + [x], pa.binary()) for x in (named, zstandard.compress(whole, 3))]
            names.clear(), texts.clear()
            return pa.RecordBatch.from_arrays(columns, ["chunk", "part", "keys", "names", "texts"])

        for batch in batches:
            for part in slices(batch):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    names.append(LAST if name is None else name)
                    texts.append(text or b"")
                    held += len(texts[-1])
                    if held >= chunk_bytes or len(names) >= CHUNK_ROWS:
                        yield flush()
                        chunk, held = chunk + 1, 0
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, CHUNKS)


def repeated(keys: DataFrame, hot: int) -> DataFrame:
    """(chunk, part, marks, n) for each (chunk, part, keys): of each key 1 if several documents have its anchor, 2 if over `hot` segments do, else 0;
    and how many segments of the chunk those are."""

    def run(group: pa.Table) -> pa.Table:
        found = [_unpack(x, "<u8", "?", "<u4") for x in group.column("keys").to_pylist()]
        sizes = np.array([len(x[0]) for x in found])
        key = np.concatenate([np.cumsum(x[0]) for x in found])
        many, times = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        chunks = np.diff(np.append(start, len(key)))
        total = np.add.reduceat(times[order].astype(np.int64), start)
        mark = np.where((chunks > 1) | np.maximum.reduceat(many[order], start), np.where(total > hot, 2, 1), 0).astype(np.uint8)
        marks = np.empty(len(key), np.uint8)
        marks[order] = np.repeat(mark, chunks)
        ends = np.cumsum(sizes)
        cut = [slice(a, b) for a, b in zip(ends - sizes, ends)]
        number = [int(times[c][marks[c] > 0].sum(dtype=np.int64)) for c in cut]
        return pa.table([group.column("chunk"), group.column("part"), pa.array([zstandard.compress(marks[c].tobytes(), 1) for c in cut], pa.binary()), pa.array(number, pa.int64())], ["chunk", "part", "marks", "n"])

    return keys.groupBy("part").applyInArrow(run, "chunk long, part int, marks binary, n long")


class Strings:
    """A chunk's distinct segments in the order in which they are sent, and which of them lies where."""

    def __init__(self, text: bytes, names: np.ndarray, lengths: np.ndarray, marks: np.ndarray, bits: int, least: int, anchor: int):
        key, start, size, document = _chunk_segments(np.frombuffer(text, np.uint8), lengths, least, anchor)
        known, _, _ = _distinct(key, document)
        mark = marks[np.searchsorted(known, key)]
        hot = np.flatnonzero(mark == 2)
        one = np.flatnonzero(mark == 1)
        single = np.arange(int(size[hot].sum())) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot]) + np.repeat(start[hot], size[hot])
        self.start = np.concatenate((start[one], single))
        self.size = np.concatenate((size[one], np.ones(len(single), np.int64)))
        self.document = np.concatenate((document[one], np.repeat(document[hot], size[hot])))
        ids: dict[bytes, int] = {}
        number = ids.setdefault
        self.of = np.fromiter((number(text[a:b], len(ids)) for a, b in zip(self.start.tolist(), (self.start + self.size + (least - 1)).tolist())), np.int64, len(self.start))
        self.strings = list(ids)
        bucket = np.empty(len(ids), np.uint64)
        bucket[self.of[: len(one)]] = key[one]
        if len(single):
            with np.errstate(over="ignore"):
                data = np.frombuffer(text, np.uint8)
                own = np.concatenate([_grams(data[a : a + n + least - 1], least) for a, n in zip(start[hot].tolist(), size[hot].tolist())])
                bucket[self.of[len(one) :]] = _mixed(_mixed(own) * FACTOR) >> np.uint64(24)
        self.bucket = (bucket >> np.uint64(40 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
        order = np.argsort(self.bucket, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.strings = [self.strings[i] for i in order.tolist()]
        self.bucket, self.of = self.bucket[order], place[self.of]
        self.first = np.full(len(ids), LAST)
        np.minimum.at(self.first, self.of, names[self.document])


SENT = "chunk long, bucket int, strings binary, sizes binary, places binary"


def sent(texts: DataFrame, marks: DataFrame, bits: int, least: int, anchor: int) -> DataFrame:
    """Rows (chunk, bucket, strings, sizes): a chunk's distinct segments in a bucket with the least doc_id of each; and a row (chunk, places) that
    says which segment lies where."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.column("chunk")[0].as_py()
        text = zstandard.decompress(left.column("texts")[0].as_py())
        names, lengths = _unpack(left.column("names")[0].as_py(), "<i8", "<i8")
        told = right.sort_by("part").column("marks").to_pylist()
        found = Strings(text, names, lengths, np.frombuffer(b"".join(map(zstandard.decompress, told)), np.uint8), bits, least, anchor)
        own, starts = np.unique(found.bucket, return_index=True)
        ends = np.append(starts[1:], len(found.strings)).tolist()
        packed = [zstandard.compress(b"".join(found.strings[a:b]), 3) for a, b in zip(starts.tolist(), ends)]
        size = np.fromiter(map(len, found.strings), np.uint16, len(found.strings))
        sizes = [_pack(size[a:b], found.first[a:b]) for a, b in zip(starts.tolist(), ends)]
        order = np.argsort(found.start, kind="stable")
        places = _pack(np.diff(found.start[order], prepend=0), found.of[order].astype(np.int64))
        rows = len(own)
        columns = [pa.array([chunk] * (rows + 1), pa.int64()), pa.array([*own.tolist(), None], pa.int32())]
        columns += [pa.array(x, pa.binary()) for x in ([*packed, None], [*sizes, None], [None] * rows + [places])]
        return pa.table(columns, ["chunk", "bucket", "strings", "sizes", "places"])

    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, SENT)


def earlier(strings: DataFrame, least: int) -> DataFrame:
    """(chunk, bucket, sizes, bits): of each string of `least` bytes in a chunk's segments, whether a document has it whose doc_id is below the
    least that its segment has in the chunk."""

    def run(group: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        number = ids.setdefault
        of, first = [], []
        for packed, sized in zip(group.column("strings").to_pylist(), group.column("sizes").to_pylist()):
            flat = zstandard.decompress(packed)
            size, name = _unpack(sized, "<u2", "<i8")
            end = np.cumsum(size, dtype=np.int64)
            of.append(np.fromiter((number(flat[a:b], len(ids)) for a, b in zip((end - size).tolist(), end.tolist())), np.int64, len(size)))
            first.append(name)
        least_name = np.full(len(ids), LAST)
        np.minimum.at(least_name, np.concatenate(of), np.concatenate(first))
        number_of, start = classes(list(ids), least)
        many = np.diff(start)
        best = np.full(int(number_of.max(initial=-1)) + 1, LAST)
        np.minimum.at(best, number_of, np.repeat(least_name, many))
        best = best[number_of]
        answers = []
        for own, name in zip(of, first):
            n = many[own]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
            answers.append(zstandard.compress(np.packbits(best[at] < np.repeat(name, n)).tobytes(), 1))
        return pa.table([group.column("chunk"), group.column("bucket"), group.column("sizes"), pa.array(answers, pa.binary())], ["chunk", "bucket", "sizes", "bits"])

    return strings.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, sizes binary, bits binary")


def covered(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of n bytes lie in a string of `least` bytes that begins at one of the starts."""
    out = np.zeros(n, bool)
    out[starts] = True
    size = 1
    while size < least:
        step = min(size, least - size)
        out[step:] |= out[:-step].copy()
        size += step
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept(texts: DataFrame, told: DataFrame, least: int) -> DataFrame:
    """The result rows of each chunk's documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = np.frombuffer(zstandard.decompress(left.column("texts")[0].as_py()), np.uint8)
        names, lengths = _unpack(left.column("names")[0].as_py(), "<i8", "<i8")
        places = [x for x in right.column("places").to_pylist() if x is not None]
        step, of = _unpack(places[0], "<i8", "<i8")
        place = np.cumsum(step)
        answers = right.filter(pc.is_valid(right.column("bits"))).sort_by("bucket")
        size, first, below = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for sized, bits in zip(answers.column("sizes").to_pylist(), answers.column("bits").to_pylist()):
            own, name = _unpack(sized, "<u2", "<i8")
            size.append(own.astype(np.int64) - (least - 1))
            first.append(name)
            below.append(np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8))[: int(size[-1].sum())].astype(bool))
        size, first, below = map(np.concatenate, (size, first, below))
        ends = np.cumsum(lengths)
        document = np.searchsorted(ends, place, "right")
        n = size[of]
        begin = (np.cumsum(size) - size)[of]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = below[np.repeat(begin, n) + nth] | np.repeat(names[document] > first[of], n)
        cover = covered((np.repeat(place, n) + nth)[gone], len(text), least)
        before = np.concatenate(([0], np.cumsum(cover)))
        start = ends - lengths
        removed = before[ends] - before[start]
        opens = cover.copy()
        opens[1:] &= ~cover[:-1]
        opens[start[lengths > 0]] = cover[start[lengths > 0]]
        spans = np.concatenate(([0], np.cumsum(opens)))
        rest = text[~cover].tobytes()
        left_end = np.cumsum(lengths - removed)
        digests = [hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip((left_end - (lengths - removed)).tolist(), left_end.tolist())]
        shown = pa.array(names, mask=names == LAST)
        return pa.table([shown, *(pa.array(x, pa.int64()) for x in (lengths, removed, spans[ends] - spans[start])), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, RESULT)


def drop_repeated(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    A byte goes if a string of `least` bytes that covers it also starts in a document of a smaller doc_id; strings are judged on the input.
    n_spans counts the maximal runs that go; the digest is of the bytes that stay. A null text is empty. A null doc_id comes after all
    others, so such rows lose what any other has; rows with equal ids do not count against each other. Texts shorter than `least` stay
    whole. Empty table: no rows. Other columns are left out.

    `anchor` and the bounds change the work, not the result: anchors that one document alone has cannot lie in a shared string, and hash
    collisions only send more segments. The transform compares the segments themselves.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = least - anchor + 1
    bits = max(0, int(np.ceil(np.log2(max(1, 2 * total / (width + 1) / part_keys)))))
    chunks = bucketed(chunked(docs, min(bits, 20), least, anchor, chunk_bytes), "chunk")  # texts are joined twice by chunk, and stay where they are
    texts = chunks.where("texts is not null").select("chunk", "names", "texts")
    marks = settled(repeated(chunks.where("part is not null").select("chunk", "part", "keys"), hot))
    segments_sent = marks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, segments_sent * (least + width / 2) / bucket_bytes)))))
    out = settled(sent(texts, marks.select("chunk", "part", "marks"), min(bits, 24), least, anchor))
    answers = earlier(out.where("bucket is not null").select("chunk", "bucket", "strings", "sizes"), least)
    none = F.lit(None).cast("binary")
    places = out.where("places is not null").select("chunk", F.lit(None).cast("int").alias("bucket"), none.alias("sizes"), none.alias("bits"), "places")
    found = settled(kept(texts, answers.withColumn("places", none).union(places), least))
    discard(chunks, marks, out)
    return found


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated(table(spark, sf_dir, "documents"))
