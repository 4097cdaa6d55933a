"""LM scoring by Brown class bigrams: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, discard, settled, slices, split_words, table
from lodestone.llm.hashing import sums

CLASSES = 32
#: So many words, the most frequent first, are clustered together on the driver until no move helps.
CORE = 2000
#: All other words move at once, at first beside the core, then beside all words; at most so many times.
ROUNDS = 3
SETTLED = 1e-4  # of the log likelihood: a round that gains no more is the last
#: A chunk ends at whichever of these it reaches first.
CHUNK_TOKENS, CHUNK_WORDS, CHUNK_ROWS = 1 << 20, 1 << 17, 1 << 16
#: Words, repeats in several chunks included, that a part of the vocabulary has on average at most.
PART_WORDS = 1 << 18
SINGLE = 64  # added to a token's state if its word came once in training; classes and what else a state says are below it
SMOOTH = 5.0


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _numbers(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _words(packed: bytes, size: int) -> list[bytes]:
    return zstandard.decompress(packed).split(b"\n") if size else []


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _edges(words: Sequence[bytes], bits: int) -> np.ndarray:
    """Where each of 2^bits parts begins among words in the order of their hashes, and the end."""
    return np.searchsorted(_hashes(words) >> np.uint64(32 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def encode(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Texts as numbers: a row a chunk of documents, with its own word list by crc32 of the words, and each word's count in training documents.

    docs: (doc_id, held_out, t binary); rows with held_out false are for training. ids, words and counts are zstandard frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        tokens: list[np.ndarray] = []
        names: list[int | None] = []
        held: list[bool | None] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total
            words = list(ids)
            order = np.argsort(_hashes(words), kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            stream = place[np.concatenate(tokens)]
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            learned = np.repeat([h is False for h in held], lengths)
            row = {
                "chunk": base + number,
                "size": len(words),
                "ids": _pack(stream.astype("<i4")),
                "lengths": lengths.astype(np.int32).tolist(),
                "doc_id": list(names),
                "held_out": list(held),
                "words": _pack(b"\n".join([words[i] for i in order])),
                "counts": _pack(np.bincount(stream[learned], minlength=len(words)).astype("<i8")),
            }
            number, total = number + 1, 0
            tokens.clear(), names.clear(), held.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for part in slices(batch, 64):
                for name, h, t in zip(*(c.to_pylist() for c in part.columns)):
                    words = split_words(t or b"")
                    tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                    names.append(name)
                    held.append(h)
                    total += len(words)
                    if total >= chunk_tokens or len(ids) >= chunk_words or len(names) >= CHUNK_ROWS:
                        yield flush()
        if names:
            yield flush()

    kinds = [("chunk", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_()))]
    schema = pa.schema([*kinds, ("words", pa.binary()), ("counts", pa.binary())])
    return docs.mapInArrow(run, "chunk long, size int, ids binary, lengths array<int>, doc_id array<long>, held_out array<boolean>, words binary, counts binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _stream(row: dict, value: np.ndarray, end: int) -> np.ndarray:
    """The training documents' tokens through value[id], an end before the first and after each."""
    lengths = np.array(row["lengths"], np.int64)
    learned = np.array([h is False for h in row["held_out"]], bool)
    tokens = value[_numbers(row["ids"], "<i4")[np.repeat(learned, lengths)]]
    return np.concatenate([np.array([end], value.dtype), np.insert(tokens, np.cumsum(lengths[learned]), end)])


def vocabulary_parts(chunks: DataFrame, bits: int) -> DataFrame:
    """(part, chunk, size, words, data): the vocabulary dealt into 2^bits parts by the words' hashes.

    A part has a row with chunk null, its words and their training counts (longs), and a row for each chunk that has some of its words: their
    places in the part's list, as differences. What chunks say about words later on goes by these places; no word is sent again.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = _words(row["words"], row["size"]), _numbers(row["counts"], "<i8")
            edges = _edges(words, bits)
            own = np.flatnonzero(np.diff(edges))
            cut = [slice(edges[p], edges[p + 1]) for p in own]
            columns = [pa.array(own, pa.int32()), pa.array(np.full(len(own), row["chunk"])), pa.array([s.stop - s.start for s in cut], pa.int32())]
            columns += [pa.array([_pack(b"\n".join(words[s])) for s in cut], pa.binary()), pa.array([_pack(counts[s]) for s in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "size", "words", "data"])

    def number(group: pa.Table) -> pa.Table:
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        said = []
        for row in _rows(group.to_batches()):
            words = _words(row["words"], row["size"])
            said.append((row["chunk"], np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), _numbers(row["data"], "<i8")))
        names = list(ids)
        order = np.argsort(_hashes(names), kind="stable")
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        total = np.zeros(len(names), np.int64)
        for _, at, n in said:
            total[place[at]] += n  # a chunk has a word once
        part = group.column("part")[0].as_py()
        rows = [{"part": part, "chunk": None, "size": len(names), "words": _pack(b"\n".join([names[i] for i in order])), "data": _pack(total)}]
        rows += [{"part": part, "chunk": c, "size": len(at), "words": None, "data": _pack(np.diff(place[at], prepend=np.int32(0)))} for c, at, _ in said]
        return pa.Table.from_pylist(rows, schema)

    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("data", pa.binary())])
    kinds = "part int, chunk long, size int, words binary, data binary"
    return chunks.select("chunk", "size", "words", "counts").mapInArrow(deal, kinds).groupBy("part").applyInArrow(number, kinds)


def vocabulary(numbered: DataFrame, classes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(word, c) of each part's words, or (word, c, cls) with classes; most: of each part only the so many most frequent of training."""

    classed = classes is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, c = _words(row["words"], row["size"]), _numbers(row["data"], "<i8")
            at = np.arange(len(words)) if most is None else np.argsort(-c, kind="stable")
            if most is not None and len(at) > most:  # ties with the last are kept, the caller's order decides
                at = at[c[at] >= c[at[most - 1]]]
            columns = [pa.array([words[i] for i in at], pa.binary()), pa.array(c[at])]
            if classed:
                columns.append(pa.array(_numbers(row["cls"], "u1")[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "cls"][: len(columns)])

    rows = numbered.where("chunk is null").select("part", "size", "words", "data")
    if classed:
        rows = rows.join(classes.select("part", "cls").hint("merge"), "part")
    return rows.mapInArrow(run, "word binary, c long" + ", cls int" * classed)


def core_pairs(chunks: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Counts of neighbouring core words in training documents; the last row and column are for the end."""
    size = len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            value = np.array([core.get(w, -1) for w in _words(row["words"], row["size"])], np.int64)
            s = _stream(row, value, size - 1)
            both = (s[:-1] >= 0) & (s[1:] >= 0)
            keys, n = np.unique(s[:-1][both] * size + s[1:][both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

    got = chunks.select("size", "ids", "lengths", "held_out", "words").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()  # at most (CORE + 1)^2 places
    return out.reshape(size, size)


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering of the words of a count matrix whose last word, the end, keeps a class of its own.

    Word by word, by descending count, a word moves to the class in which the class bigrams' likelihood is highest; sweeps go on
    until one moves nothing. Returns each word's class and the classes' count matrix.
    """
    words = len(pairs) - 1
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[:words], kind="stable")
    of = np.empty(words + 1, np.int64)
    of[order] = np.arange(words) % classes
    of[words] = classes
    k = classes + 1
    one = np.zeros((words + 1, k))
    one[np.arange(words + 1), of] = 1
    n = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own, same = of[w], pairs[w, w]
            before = np.bincount(of, pairs[:, w], k)
            after = np.bincount(of, pairs[w], k)
            before[own] -= same
            after[own] -= same
            n[own] -= after
            n[:, own] -= before
            n[own, own] -= same
            rows, columns = n.sum(1), n.sum(0)
            held = _nlogn(n)
            up, left = _nlogn(n + after) - held, _nlogn(n + before[:, None]) - held
            d = np.arange(k)
            gain = up.sum(1) - up[d, d] + left.sum(0) - left[d, d] + _nlogn(n[d, d] + after + before + same) - held[d, d]
            # every row gains its words before w, every column its words after, whichever the class; only the class's own gain more
            gain -= _nlogn(rows + before + after.sum() + same) - _nlogn(rows + before)
            gain -= _nlogn(columns + after + before.sum() + same) - _nlogn(columns + after)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[own] + 1e-9:
                new = own
            n[new] += after
            n[:, new] += before
            n[new, new] += same
            of[w] = new
            moved += new != own
        if not moved:
            break
    return of[:words], n


def _beside(row: dict, words: list[bytes], bits: int, side: np.ndarray, word: np.ndarray, k: int) -> list[dict]:
    """Rows (part, chunk, data) of a chunk: for each of its words in the part how many codes it has, and these with their counts.

    Codes are the classes before a word, and k more those after it. Below 0: no class, no word.
    """
    left, right = (word[1:] >= 0) & (side[:-1] >= 0), (word[:-1] >= 0) & (side[1:] >= 0)
    keys, n = np.unique(np.concatenate([word[1:][left] * 2 * k + side[:-1][left], word[:-1][right] * 2 * k + k + side[1:][right]]), return_counts=True)
    edges, out = _edges(words, bits), []
    starts = np.searchsorted(keys, np.arange(len(words) + 1) * 2 * k)
    for p in np.flatnonzero(np.diff(edges)):
        a, b = starts[edges[p]], starts[edges[p + 1]]
        if a < b:
            data = [np.diff(starts[edges[p] : edges[p + 1] + 1]).astype("u1"), (keys[a:b] % (2 * k)).astype("u1"), n[a:b].astype("<i8")]
            out.append({"part": int(p), "chunk": row["chunk"], "data": _pack(b"".join(x.tobytes() for x in data))})
    return out


BESIDE = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def beside_core(chunks: DataFrame, core: dict[bytes, int], k: int, bits: int) -> DataFrame:
    """The rows of `_beside` of all words, next to the core's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = _words(row["words"], row["size"])
            cls = np.array([core.get(w, -1) for w in words], np.int64)
            side, word = _stream(row, cls, k - 1), _stream(row, np.arange(len(words)), -1)
            yield from pa.Table.from_pylist(_beside(row, words, bits, side, word, k), BESIDE).to_batches()

    return chunks.select("chunk", "size", "ids", "lengths", "held_out", "words").mapInArrow(run, "part int, chunk long, data binary")


def answers(numbered: DataFrame, classes: DataFrame, counts: bool) -> DataFrame:
    """(of, part, cls, c): to each chunk the classes of its words in each part, and if asked their counts in training."""

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        cls = _numbers(right.column("cls")[0].as_py(), "u1")
        c = next(_numbers(r["data"], "<i8") for r in rows if r["chunk"] is None)
        out = []
        for r in rows:
            if r["chunk"] is not None:
                at = np.cumsum(_numbers(r["data"], "<i4"))
                out.append({"of": r["chunk"], "part": r["part"], "cls": _pack(cls[at]), "c": _pack(c[at]) if counts else None})
        return pa.Table.from_pylist(out, pa.schema([("of", pa.int64()), ("part", pa.int32()), ("cls", pa.binary()), ("c", pa.binary())]))

    left = numbered.select("part", "chunk", "data").groupBy("part")
    return left.cogroup(classes.select(F.col("part").alias("p"), "cls").groupBy("p")).applyInArrow(reply, "of long, part int, cls binary, c binary")


def _joined(right: pa.Table, name: str, kind: str) -> np.ndarray:
    """A chunk's answers in the order of its words."""
    got = sorted(zip(right.column("part").to_pylist(), right.column(name).to_pylist()))
    return np.concatenate([np.zeros(0, kind), *(_numbers(x, kind) for _, x in got)])


def beside_all(chunks: DataFrame, replies: DataFrame, k: int, bits: int) -> DataFrame:
    """The rows of `_beside` of all words next to all words, and with part -1 each chunk's k x k counts of neighbouring classes."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        cls, out = _joined(right, "cls", "u1").astype(np.int64), []
        for row in left.to_pylist():
            words = _words(row["words"], row["size"])
            side = _stream(row, cls, k - 1)
            out += _beside(row, words, bits, side, _stream(row, np.arange(len(words)), -1), k)
            out.append({"part": -1, "chunk": row["chunk"], "data": _pack(np.bincount(side[:-1] * k + side[1:], minlength=k * k).astype("<i8"))})
        return pa.Table.from_pylist(out, BESIDE)

    left = chunks.select("chunk", "size", "ids", "lengths", "held_out", "words").groupBy("chunk")
    return left.cogroup(replies.select("of", "part", "cls").groupBy("of")).applyInArrow(meet, "part int, chunk long, data binary")


def class_pairs(found: DataFrame, k: int) -> np.ndarray:
    """The sum of the rows with part -1: counts of neighbouring classes, the end's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for row in _rows(batches):
            total += _numbers(row["data"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["pair", "n"])

    out = np.zeros(k * k)
    for r in found.where("part = -1").select("data").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[r[0]] = r[1]  # at most k^2 rows
    return out.reshape(k, k)


def _gains(counts: np.ndarray) -> np.ndarray:
    """For each code of `_beside` the gain of each class, to first order: log N(c, b) / N(b)."""
    joint = counts[:, :-1] + 0.1
    to = np.log(joint / joint.sum(0, keepdims=True))
    back = counts[:-1].T + 0.1
    return np.concatenate([to, np.log(back / back.sum(0, keepdims=True))])


def move(found: DataFrame, numbered: DataFrame, counts: np.ndarray, core: dict[bytes, int]) -> DataFrame:
    """(part, cls, totals): each word's best class beside its neighbours, and the training tokens of each class in the part.

    All words move at once, given the classes' counts; core words stay. A word without a neighbour takes the commonest class.
    """
    k = len(counts)
    gains, usual = _gains(counts), int(counts.sum(0)[: k - 1].argmax())

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        places, size = {}, 0
        for r in right.to_pylist():
            if r["chunk"] is None:
                words, c, size = _words(r["words"], r["size"]), _numbers(r["data"], "<i8"), r["size"]
            else:
                places[r["chunk"]] = np.cumsum(_numbers(r["data"], "<i4"), dtype=np.int64)
        if not size:
            return pa.Table.from_pylist([], schema)
        met = np.zeros(size * 2 * k, np.float32)
        for r in left.to_pylist():
            at, raw = places[r["chunk"]], zstandard.decompress(r["data"])
            many = np.frombuffer(raw, "u1", len(at))
            number = int(many.sum(dtype=np.int64))
            codes, n = np.frombuffer(raw, "u1", number, len(at)), np.frombuffer(raw, "<i8", number, len(at) + number)
            met[np.repeat(at, many) * 2 * k + codes] += n  # a chunk has a word and code once
        met = met.reshape(size, 2 * k)
        cls = (met @ gains.astype(np.float32)).argmax(1)
        cls[met.sum(1) == 0] = usual
        held = np.array([core.get(w, -1) for w in words])
        cls = np.where(held >= 0, held, cls)
        totals = np.bincount(cls, c, k - 1).astype(np.int64).tolist()
        part = right.column("part")[0].as_py()
        return pa.Table.from_pylist([{"part": part, "cls": _pack(cls.astype("u1")), "totals": totals}], schema)

    schema = pa.schema([("part", pa.int32()), ("cls", pa.binary()), ("totals", pa.list_(pa.int64()))])
    left = found.where("part >= 0").select(F.col("part").alias("p"), "chunk", "data").groupBy("p")
    return left.cogroup(numbered.groupBy("part")).applyInArrow(best, "part int, cls binary, totals array<long>")


def likelihood(n: np.ndarray) -> float:
    return float(_nlogn(n).sum() - _nlogn(n.sum(0)).sum() - _nlogn(n.sum(1)).sum())


@dataclass
class Learned:
    """Settled tables of the texts and the vocabulary, the words' classes, and figures of the training documents."""

    chunks: DataFrame
    numbered: DataFrame
    classes: DataFrame
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    documents: int
    totals: np.ndarray  # training tokens of each class
    rounds: int  # in which words moved


def learn(named: DataFrame, classes: int, core: int, rounds: int, chunk_tokens: int, chunk_words: int, part_words: int) -> Learned:
    """Clusters the words of training rows of (doc_id, held_out, t)."""
    k = classes + 1
    chunks = settled(encode(named, chunk_tokens, chunk_words))
    said, documents = chunks.agg(F.sum("size"), F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()
    documents = documents or 0
    bits = max(0, math.ceil(math.log2(max(1, (said or 0) / part_words))))
    numbered = settled(vocabulary_parts(chunks, bits))
    frequent = vocabulary(numbered, most=core).where("c > 0").orderBy(F.desc("c"), "word").limit(core).collect()  # at most `core` rows
    index = {w: i for i, w in enumerate(sorted(bytes(r.word) for r in frequent))}
    of, counts = exchange(core_pairs(chunks, index), classes)
    fixed = {w: int(of[i]) for w, i in index.items()}
    found = settled(beside_core(chunks, fixed, k, bits))
    now = settled(move(found, numbered, counts, fixed))
    discard(found)
    done, before = 1, None
    while documents and done < rounds:
        found = settled(beside_all(chunks, answers(numbered, now, False), k, bits))
        counts = class_pairs(found, k)
        reached = likelihood(counts)
        if before is not None and reached <= before + SETTLED * abs(before):
            discard(found)
            break
        new = settled(move(found, numbered, counts, fixed))
        discard(found, now)
        now, before, done = new, reached, done + 1
    totals = np.zeros(classes)
    for r in now.select(F.posexplode("totals").alias("cls", "n")).groupBy("cls").agg(F.sum("n")).collect():
        totals[r[0]] = r[1]  # a row a class
    known = vocabulary_sizes(numbered)
    return Learned(chunks, numbered, now, int(totals.sum()) + documents, known + (documents > 0), documents, totals, done)


def vocabulary_sizes(numbered: DataFrame) -> int:
    """The number of words that training documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int((_numbers(row["data"], "<i8") > 0).sum())], pa.int64())], ["n"])

    return numbered.where("chunk is null").select("data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def states(learned: Learned) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, emitted, states) of each document.

    states: a byte a word: its class, SINGLE more if the word came once in training, the number of classes + 1 if it never did.
    emitted: the sum of log10 of the known words' shares of their classes.
    """
    k, totals, documents = len(learned.totals), learned.totals, learned.documents
    below = learned.tokens + 0.5 * (learned.distinct + 1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "states")}
        c, cls = _joined(right, "c", "<i8"), _joined(right, "cls", "u1").astype(np.int64)
        seen = c > 0
        cls[~seen] = k + 1
        share = np.zeros(len(c))
        share[seen] = np.log10(c[seen] / totals[cls[seen]])
        plain = np.log10((c + 0.5) / below)
        state = (cls + SINGLE * (c == 1)).astype(np.uint8)
        end = math.log10((documents + 0.5) / below)
        for row in left.to_pylist():
            ids = _numbers(row["ids"], "<i4")
            lengths = np.array(row["lengths"], np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            s = state[ids].tobytes()
            out["doc_id"] += row["doc_id"]
            out["held_out"] += row["held_out"]
            out["n_tokens"].append(lengths + 1)
            out["n_known"].append(sums(seen[ids].astype(float), lengths).astype(np.int64) + (documents > 0))
            out["base_score"].append(sums(plain[ids], lengths) + end)
            out["emitted"].append(sums(share[ids], lengths))
            out["states"] += [s[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "states": pa.binary()}
        return pa.table({n: pa.array(v, kinds[n]) if n in kinds else pa.array(np.concatenate(v) if v else []) for n, v in out.items()})

    left = learned.chunks.select("chunk", "ids", "lengths", "doc_id", "held_out").groupBy("chunk")
    right = answers(learned.numbered, learned.classes, True).groupBy("of")
    return left.cogroup(right).applyInArrow(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, states binary")


def _flat(states: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States before and after each step of the documents, ends at both sides, and the number of steps of each."""
    end = bytes([k])
    s = np.frombuffer(end.join([b"", *states, b""]), np.uint8)  # an end, a document, an end, ...
    lengths = np.fromiter((len(x) + 1 for x in states), np.int64, len(states))
    return s[:-1], s[1:], lengths


def transitions(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of state pairs in training documents, plain and with single words taken as unknown ones."""
    m = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m * m), np.int64)
        for batch in batches:
            for part in slices(batch):
                a, b, _ = _flat(part.column(0).to_pylist(), k)
                for i, unknown in enumerate((False, True)):
                    x, y = ((np.where(v >= SINGLE, k + 1, v) if unknown else v % SINGLE).astype(np.int64) for v in (a, b))
                    total[i] += np.bincount(x * m + y, minlength=m * m)
        i, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * m * m + pair), pa.array(total[i, pair])], ["pair", "n"])

    out = np.zeros(2 * m * m)
    for r in docs.where("not held_out").select("states").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[r[0]] = r[1]  # at most 2 (k + 2)^2 rows
    return tuple(out.reshape(2, m, m))


def log_table(plain: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """log10 P(state after | state before).

    Unknown words take the share that words seen once have after the state (Good and Turing); after an unknown word, what followed
    single words counts. Known classes share the rest by transition counts, smoothed towards the classes' shares.
    """
    m = len(plain)
    known = plain[:, :-1].copy()
    known[-1] = unknown[-1, :-1]
    overall = (plain[:, :-1].sum(0) + 1e-3) / (plain[:, :-1].sum() + 1e-3 * (m - 1))
    after = known.sum(1, keepdims=True)
    share = (known + SMOOTH * overall) / (after + SMOOTH)
    floor = (unknown[:, -1].sum() + 0.5) / (unknown.sum() + 1)
    new = np.minimum(0.9, (unknown[:, -1] + SMOOTH * floor) / (unknown.sum(1) + SMOOTH))
    return np.log10(np.concatenate([share * (1 - new)[:, None], new[:, None]], 1))


def score_documents(
    docs: DataFrame, mod: int = 5, held: int = 1, classes: int = CLASSES, core: int = CORE, rounds: int = ROUNDS, chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS, part_words: int = PART_WORDS
) -> DataFrame:
    """Scores all whole texts (null: empty) by a class bigram model learned from those whose crc32(doc_id) mod `mod` is not `held`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (10 ** (-score / n_tokens)).
    P(word | word before) = P(class | class before) P(word | class); classes come from exchange clustering: the `core` most frequent
    words on the driver until no move helps, then all other training words, moving together, at most `rounds` times or until the
    likelihood settles. Training reads all training documents; what tasks exchange grows with the corpus.
    The driver holds the count matrices of at most `core` words and of classes; a task one chunk, or one part of the vocabulary.
    A null doc_id is scored but not learned from, held_out null. Nothing to learn from: score is base_score. Repeated rows
    count as often; an empty table gives none; other columns are ignored.
    """
    if not 1 <= classes <= SINGLE - 2:
        raise ValueError(f"classes are 1 to {SINGLE - 2}")
    named = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", mod) == held).alias("held_out"), F.col("text").cast("binary").alias("t"))
    model = learn(named, classes, core, rounds, chunk_tokens, chunk_words, part_words)
    scored = settled(states(model))
    discard(model.chunks, model.numbered, model.classes)
    logs, learned, tokens = log_table(*transitions(scored, classes)), model.documents > 0, model.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, b, lengths = _flat(part.column(6).to_pylist(), classes)
                path = sums(logs[a % SINGLE, b % SINGLE], lengths)
                base = part.column(4).to_numpy()
                score = path + part.column(5).to_numpy() if learned else base
                perplexity = 10 ** np.minimum(300, -score / part.column(2).to_numpy())
                train = pa.array(np.full(len(base), tokens))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], train, part.column(4), pa.array(score), pa.array(perplexity)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return scored.mapInArrow(run, schema)


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
