"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text the last token of its encoding is unique. It is found from shorter prefixes: of the
tokens that end the prefix, the one that may follow the last token of what stands before it. Two tokens may follow each
other if merging their joined bytes gives just these two. The table of last tokens is the state: bytes are appended by
going on from it, and an edit recomputes from its first byte until the table agrees with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .packing import id_lists
from .segments import SegmentEncoder

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixTable:
    """Ranks of a vocabulary, which tokens may follow each other, and encodings made from both."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Ids by merging the pair of least rank first; asked for two tokens' bytes at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_stand(self, token: int) -> bool:
        """Whether merging the token's own bytes gives it."""
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self._merged(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        if (known := self._pairs.get((left, right))) is None:
            known = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._pairs) >= 2_000_000:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def follows(self, last: list[int], begin: int, token: int) -> bool:
        """Whether token, begun at begin, ends the encoding of a prefix, given the last tokens of the shorter ones."""
        if not begin:
            return self.may_stand(token)
        known = self._pairs.get((last[begin], token))
        return self.may_follow(last[begin], token) if known is None else known

    def last_token(self, data: bytes | bytearray, end: int, last: list[int]) -> int:
        """Of data[:end]; last[i] is that of data[:i] for 0 < i < end."""
        for begin in range(max(0, end - self.longest), end):
            token = self.ranks.get(bytes(data[begin:end]))
            if token is not None and self.follows(last, begin, token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, data: bytes) -> list[int]:
        """Last tokens of all prefixes; that of the empty one is -1. The automaton names the tokens that end at each
        byte, so that only these are tried."""
        last, found, pairs = [-1] * (len(data) + 1), 0, self._pairs
        for at, (length, token) in self.ends.iter(data.decode("latin-1")):
            if at == found - 1:
                continue
            begin = at + 1 - length
            known = pairs.get((last[begin], token)) if begin else None
            if self.follows(last, begin, token) if known is None else known:
                found = at + 1
                last[found] = token
        return last

    def read_back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, whether merges reach it or not."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.table(data))


class EditablePiece:
    """A piece of text with its table of last tokens."""

    def __init__(self, table: PrefixTable, data: bytes = b""):
        self.table, self.data, self.last = table, bytearray(), [-1]
        self.recomputed = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.table.last_token(self.data, end, self.last))
            self.recomputed += 1

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replaces data[begin:end]. Behind the new bytes the old table holds again once it has agreed over as many
        prefixes as the longest token has bytes: each later entry depends on no others."""
        self.data[begin:end] = new
        kept, self.last = self.last[end + 1 :], self.last[: begin + 1]
        same = 0
        for at in range(begin + 1, len(self.data) + 1):
            behind = at - begin - len(new) - 1
            if same >= self.table.longest:
                self.last += kept[behind:]
                break
            self.last.append(self.table.last_token(self.data, at, self.last))
            self.recomputed += 1
            same = same + 1 if behind >= 0 and kept[behind] == self.last[-1] else 0

    def ids(self) -> list[int]:
        whole = self.table.ranks.get(bytes(self.data))
        return [whole] if whole is not None else self.table.read_back(self.last)


class Codec:
    """Encodes and decodes whole texts: each match of pattern separately."""

    def __init__(self, path: str, pattern: str):
        self.table, split = PrefixTable(read_ranks(path)), regex.compile(pattern)
        piece = self.table.encode_piece

        def encode(text: str) -> bytes:
            ids = [i for part in split.findall(text) for i in piece(part.encode())]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.encode = SegmentEncoder(encode)

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.table.bytes_of.__getitem__, numbers))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each vocabulary and worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex of the ids as little-endian unsigned
    32-bit integers and of the decoded bytes), and ids (array of int) if with_ids.

    A null or empty text has no ids; repeated rows stand as often as given; other columns are not looked at; an empty
    table gives an empty one. One pass over the texts without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, hashes, decoded, lists = [], [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(id_lists(counts, b"".join(lists)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return wanted.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
