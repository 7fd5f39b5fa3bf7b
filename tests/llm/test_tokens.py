"""Packing and byte-level BPE against the libraries and plain Python."""

import random
import struct
import weakref
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rulestone.llm import bpe, packing, segments
from rulestone.llm.common import begin

DOCS = "doc_id long, text string, start int, ids string"
SIGNS = [" ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "a", "b", "'s", "'ll", "é", "1", "23", ".", "!", "<|endoftext|>", "的", "😀", "́", "​", "\x00"]


def odd_texts(n=3000):
    pick = random.Random(2)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randint(0, 14))) for _ in range(n)] + ["word " * 3000, "x" * 500, "naïve coöperation"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segments_give_the_ids_of_whole_texts(tokenizer, encoding):
    ours = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    other = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert ours(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        ids = encoding.encode_ordinary(text)
        assert other.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert other.decode(other.encode(text)) == text.encode()


def test_appends_and_edits_are_exact():
    table = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).table
    pick = random.Random(3)
    for _ in range(60):
        data = "".join(pick.choice("aeinorstéñ ") for _ in range(pick.randint(0, 400))).encode()
        piece = bpe.EditablePiece(table, data[:50])
        piece.append(data[50:])
        assert piece.last == table.table(data)
        for _ in range(4):
            lo = pick.randint(0, len(data))
            hi = min(len(data), lo + pick.randint(0, 9))
            new = "".join(pick.choice("xyzaeé") for _ in range(pick.randint(0, 5))).encode()
            data = data[:lo] + new + data[hi:]
            piece.edit(lo, hi, new)
            assert bytes(piece.data) == data and piece.last == table.table(data)
            assert piece.ids() == table.encode_piece(data)


def test_an_edit_recomputes_little():
    table = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).table
    piece = bpe.EditablePiece(table, b"some words that go on " * 200)
    before = piece.recomputed
    piece.edit(100, 101, b"q")
    assert piece.recomputed - before < table.longest + 60


def test_binary_lengths():
    for n in [0, 1, 2, 3, 1023, 1024, 1025, 5000]:
        found = packing.binary_lengths(n)
        assert sum(found) == n and found == sorted(found, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 1024 for x in found)
        assert len([x for x in found if x < 1024]) == len({x for x in found if x < 1024})


def test_pack(spark, tokenizer):
    texts = [*odd_texts(200), None, "", "long " * 4000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    assert len({r.sequence_id for r in found}) == len(found) and {r.offset for r in found} == {0}
    by_doc = {}
    for r in found:
        assert len(r.ids) == r.length == 1 << r.bucket <= 1024
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        by_doc.setdefault(r.doc_id, []).append((r.start, list(r.ids), r.doc_tokens))
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i])[:: 2 if i == 0 else 1]
        assert [x for _, own, _ in pieces for x in own] == ids
        assert all(total == len(ids) for _, _, total in pieces)
    assert packing.pack(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_encode(spark, encoding):
    texts = [*odd_texts(100), None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS)
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in found} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_a_worker_lets_go_of_what_another_operator_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    held = weakref.ref(packing.encoder(path))
    begin("packing")
    assert held() is not None and packing.encoder(path) is held()
    begin("toxicity")
    assert held() is None


def test_memories_of_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(segments, "MOST", 10)
    encode = segments.SegmentEncoder(str.encode)
    text = " ".join(f"w{i % 37}{'!?;'[i % 3]}" for i in range(300))
    assert encode(text) == text.encode()
    assert all(len(m) <= 10 and len(m.older) <= 10 for m in (encode.first, encode.later, encode.later.tails))
