"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of binary lengths: as many of the longest length as fit, then one for each bit
of what is left, from long to short. Every piece is a sequence of its own, so no sequence crosses documents and none is
padded; sequences of one length form a bucket, which a trainer can batch without padding.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, give_back, kept, text_or_empty
from .segments import SegmentEncoder

#: Documents that a worker holds the pieces of at once.
ROWS = 1000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def binary_lengths(n: int, longest: int = 1024) -> list[int]:
    """n as a sum of powers of two, none over longest (itself a power of two), in falling order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_alphabet() -> dict[int, int]:
    """How byte-level BPE writes bytes as characters: printable ones as themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def id_lists(lengths: list[int], ids: bytes) -> pa.Array:
    """Lists of such lengths, one after the other, of little-endian 32-bit integers."""
    bounds = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(ids, "<i4")))


def encoder(path: str) -> SegmentEncoder:
    """One for each tokenizer file and worker process, while it packs."""

    def make() -> SegmentEncoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        model, shown = tokenizer.model, byte_alphabet()

        def encode(text: str) -> bytes:
            # letters with a space before them are one piece, which goes to the model without being split
            if text.isalpha() or text[:1] == " " and text[1:].isalpha():
                ids = [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(shown))]
            else:
                ids = tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()

        return SegmentEncoder(encode)

    return kept("packing", path, make)


def pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), and ids (array of
    int) if with_ids. tokenizer: path of a tokenizers file, readable on the executors.

    A null or empty text is the end id alone; repeated rows are packed as often as they stand; other columns are not
    looked at; an empty table gives no pieces. One pass over the texts, without a shuffle, a document at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                rows: list[list] = [[] for _ in range(6)]
                texts: list[bytes] = []
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1), strict=True):
                    data = encode(text.as_py()) + end
                    total, start = len(data) // 4, 0
                    for length in binary_lengths(total, longest):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        row = (doc_id, start, length, crc, total, length.bit_length() - 1)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        start += length
                    if with_ids:
                        texts.append(data)
                columns = [pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 5 + [pa.int32()], strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:  # pieces follow each other as their documents do
                    columns.append(id_lists(rows[2], b"".join(texts)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        batch = few = columns = text = None
        give_back()

    wanted = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return wanted.mapInArrow(cut, SCHEMA + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """pieces() with each one's sequence: sequence_id (unique; pieces of one input partition follow each other) and
    offset 0, as a sequence holds one piece."""
    return pieces(docs, tokenizer, longest, end_id, with_ids).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
