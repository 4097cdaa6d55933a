"""Packing token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, table

LENGTH = 2048
#: A group ends with the document that brings it to so many tokens (16 MB of ids).
GROUP_TOKENS = 1 << 22
END = (1).to_bytes(4, "little")


class Kept(dict):
    """Keys and what `make` makes of them: at least the last `most` keys to come up are kept, at most twice as many."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: Texts by which a tokenizer shows whether a text's ids are those of its words, and a word's those of its letters and tail.
PROBES = [x.encode() for x in ("Hello world", " two  spaces\tand\nlines ", "naïve Élan ÀÉÎ straße", "don't can't I'll", "abc123 x,y a-b.c (see) end.", "UPPER lower MiXeD", "1234 5.6 %% ...", "日本 слово e\u0301")]


class WordIds:
    """Texts' ids as little-endian bytes, by way of their words.

    Pre-tokens of the tokenizer never cross ASCII white space, so a text's ids are those of its words in turn. A word of Latin letters that
    ASCII other than letters may follow is two parts, whose ids follow each other: the letters, lower-cased, are one pre-token, which
    goes straight to the merges; the tail starts another. Other words and tails go through the whole tokenizer.
    """

    PARTS = re.compile(r"([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-@\[-`{-~][!-~]*)?", re.ASCII)

    def __init__(self, path: str, words: int = 1_000_000, parts: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        tokens = Tokenizer.from_file(path)
        self.encode, self.merge = tokens.encode, tokens.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: level(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.words, self.stems, self.tails = Kept(self._word, words), Kept(self._stem, parts), Kept(self._text, words)
        self.by_words = self._fits()
        for kept in (self.words, self.stems, self.tails):
            kept.clear()

    def _fits(self) -> bool:
        """Whether the tokenizer works by words and parts as this class does; if not, whole texts go through it."""
        try:
            return all(b"".join(map(self._word, probe.split())) == self._text(probe.decode()) for probe in PROBES)
        except Exception:  # a model without merges of its own, or letters that it doesn't know
            return False

    def _text(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def _stem(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters.translate(self.letters))]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = self.PARTS.fullmatch(text)
        if not m:
            return self.tails[text]
        stem = self.stems[m[1].lower()]
        return stem + self.tails[m[2]] if m[2] else stem

    def text(self, text: bytes) -> bytes:
        if not self.by_words:
            return self._text(text.decode("utf-8", "replace"))
        ids = b"".join(map(self.words.__getitem__, text.split()))
        for kept in (self.words, self.stems, self.tails):
            kept.trim()
        return ids


_words: dict[str, WordIds] = {}


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers. The tree's inner nodes hold the most room of any bin below; the first bin that has enough is log(n) steps away."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins: list[list[int]] = [[] for _ in range(leaves)]
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, at = sizes[item], 1
        while at < leaves:
            at *= 2
            at += tree[at] < size
        bins[at - leaves].append(item)
        tree[at] -= size
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left >= right else right
            if tree[at] == most:
                break
            tree[at] = most
    return [b for b in bins if b]


def pack(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each document's tokens exactly once.

    Whole sequences are cut from long documents, their remainders packed by first-fit decreasing. The emptiest bins then
    give pieces, cut where need be, to the gaps of the fullest; the tokens of the one bin that is left
    make sequences of powers of two, which need no padding.
    """
    sequences = [[(d, at, length)] for d, n in enumerate(lengths) for at in range(0, n - length + 1, length)]
    tails = [(d, n - n % length, n % length) for d, n in enumerate(lengths) if n % length]
    bins = [[tails[i] for i in b] for b in first_fit_decreasing([t[2] for t in tails], length)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    room = [length - sum(p[2] for p in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if not room[i]:
            i += 1
        elif not bins[j]:
            j -= 1
        else:
            d, at, n = bins[j].pop()
            move = min(n, room[i])
            bins[i].append((d, at + n - move, move))
            room[i] -= move
            room[j] += move
            if move < n:
                bins[j].append((d, at, n - move))
    if bins and j >= 0 and room[j]:
        rest = bins.pop(j)[::-1]
        bins = bins[:j]
        while rest:
            part: list[tuple[int, int, int]] = []
            left = 1 << (sum(p[2] for p in rest).bit_length() - 1)
            while left:
                d, at, n = rest.pop()
                part.append((d, at, min(n, left)))
                if n > left:
                    rest.append((d, at + left, n - left))
                left -= part[-1][2]
            bins.append(part)
    return sequences + [b for b in bins if b]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, seed: int = 42) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each ended by id 1.

    A seeded hash of doc_id and text deals the documents out over tasks and orders them there; runs of them of about group_tokens
    tokens are packed on their own, so memory is bounded by that and the longest document. No sequence needs padding: each has `length`
    tokens or a power of two. Null or empty texts are their end id alone. A null doc_id stays; rows that repeat are packed
    as often as they come. Empty table: no rows. Other columns are ignored. tokenizer: the path of the
    tokenizers file, which every executor must hold.
    """
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.setdefault(tokenizer, None) or WordIds(tokenizer)
        _words[tokenizer] = words
        next_id = TaskContext.get().partitionId() << 40
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            lengths = [len(x) // 4 for x in ids]
            out: list[list] = [[] for _ in cols]
            for pieces in pack(lengths, length):
                offset = 0
                for d, at, n in pieces:
                    crc = zlib.crc32(memoryview(ids[d])[4 * at : 4 * (at + n)])
                    for column, value in zip(out, (names[d], at, n, crc, lengths[d], next_id, offset)):
                        column.append(value)
                    offset += n
                next_id += 1
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], cols)

        for batch in batches:
            for part in slices(batch):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    names.append(name)
                    ids.append(words.text(text or b"") + END)
                    held += len(ids[-1]) // 4
                    if held >= group_tokens:
                        yield flush()
        if ids:
            yield flush()

    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"), h.alias("h")).repartition("h").sortWithinPartitions("h", "doc_id")
    return dealt.select("doc_id", "t").mapInArrow(run, ", ".join(f"{c} long" for c in cols))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
