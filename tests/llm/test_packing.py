import glob
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import WordIds, first_fit_decreasing, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_an_exact_round_trip(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Hello", "naïve", "ß", "1234", "don't", "<|endoftext|>", "\x1c", "a b", "é"]) for _ in range(rng.randrange(900))) for _ in range(50)]
    texts += [None, "", " ", "word " * 9000, "same", "same"]
    ids = [*range(len(texts) - 2), 7, None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, start int").repartition(4)
    rows = pack_documents(docs, PATH, group_tokens=9000).collect()
    tokens = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in zip(ids, texts):
        want[i].append(array("I", [*tokens.encode(t or "", add_special_tokens=False).ids, 1]).tobytes())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(len(x) // 4 for v in want.values() for x in v)
    for i, encoded in want.items():
        for x in encoded:
            if sum(len(y) == len(x) for y in encoded) > 1:
                continue
            at = 0
            for r in sorted(by_doc[i, len(x) // 4], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(x[4 * at : 4 * (at + r.length)])
                at += r.length
            assert at == len(x) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    again = pack_documents(docs.repartition(2), PATH, group_tokens=9000).collect()
    assert sum(r.length for r in again) == sum(r.length for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_first_fit_matches_a_plain_scan(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 200))]
    room, want = [], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[item]), None)
        if at is None:
            at = len(room)
            room.append(100)
            want.append([])
        room[at] -= sizes[item]
        want[at].append(item)
    assert first_fit_decreasing(sizes, 100) == want


def test_pack_of_nothing_and_of_one():
    assert pack([]) == []
    assert pack([2048]) == [[(0, 0, 2048)]]
    assert [sum(p[2] for p in s) for s in pack([5])] == [4, 1]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("path", sorted(glob.glob("/opt/tokenizers/*.json")))
def test_ids_of_any_tokenizer(path):
    rng = random.Random(3)
    try:
        tokens = Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no tokenizer file")
    words = WordIds(path)
    parts = ["Hello", "naïve", "ß", "1234", "don't", "a b", "é", "(x)", "end.", "  ", "\t", "ABC", "日本", "foo_bar", "e\u0301"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert words.text(text.encode()) == array("I", tokens.encode(text, add_special_tokens=False).ids).tobytes()
