"""Byte-level BPE encoding and decoding in linear time, by longest matches and backtracking.

A rank file lists the tokens (byte strings) in the order in which their merges were learned. The
exact result of applying the merges in that order is found without applying them:

* bytes are mapped to Latin-1 characters, and an Aho-Corasick automaton over the tokens gives the
  longest token at every place of a piece in one pass;
* a sequence of tokens is what the merges give if and only if every two neighbours are compatible:
  undoing their last merges step by step, no merge across their border would have come earlier.
  The answer for a pair of tokens is kept, as the same pairs come again and again;
* tokens are taken greedily from the left, the longest compatible one first. When none fits, the
  last token is taken back and its place marked, so that no place is tried twice.

Defined results: NULL text counts as empty (no ids, no bytes); repeated rows each give a row; an
empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.tokens import BLANKS_PATTERN, LATIN_PARTS, NOT_LATIN

_NO_LIMIT = 1 << 60


class ByteBPE:
    """Encoder and decoder for the ranks of a tiktoken file; ranks must be 0, 1, 2 …"""

    def __init__(self, path: str, pattern: str, most_cached: int = 500_000):
        import ahocorasick
        import regex

        with open(path, "rb") as file:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
        self._bytes = [token for _, token in ranked]
        self._id = {token: i for i, token in enumerate(self._bytes)}
        self._automaton = ahocorasick.Automaton()
        for i, token in enumerate(self._bytes):
            self._automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self._automaton.make_automaton()
        self._length = [len(token) for token in self._bytes]
        self._shorter = [self._longest_proper_prefix(token) for token in self._bytes]
        self._halves: list[tuple[int, int]] = []
        self._merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._learn_merges()
        self._fits.clear()
        self._pattern = regex.compile(pattern)
        # The same parts of Latin text by ``re``, which is faster; only this pattern has such a form.
        self._latin_parts = LATIN_PARTS["blanks"] if pattern == BLANKS_PATTERN else self._pattern
        self._most_cached = most_cached
        self._pieces: dict[str, bytes] = {}

    def _longest_proper_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (i := self._id.get(token[:end])) is not None:
                return i
        return -1

    def _learn_merges(self) -> None:
        """The two earlier tokens that each token was merged from (itself twice for a byte)."""
        for i, token in enumerate(self._bytes):
            left = self._shorter[i]
            halves = (i, i)
            while left >= 0:
                right = self._id.get(token[self._length[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    halves = (left, right)
                    self._merged[halves] = i
                    break
                left = self._shorter[left]
            self._halves.append(halves)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between these neighbours."""
        limit = _NO_LIMIT
        halves, merged = self._halves, self._merged
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                # The later of the two merges is undone; a merge across the border would have to be earlier.
                limit = left
                left = halves[left][1]
                if left != limit:
                    continue
                limit = right + 1
                right = halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit = right + 1
                right = halves[right][0]
                if right + 1 != limit:
                    continue
                limit = left
                left = halves[left][1]
                if left == limit:
                    return True

    def _fit(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > self._most_cached:
                self._fits.clear()
            known = self._fits[pair] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self._id.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = array("l", bytes(array("l").itemsize * size))
        for end, (token, length) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # a later end is a longer token
        dead = bytearray(size + 1)
        out: list[int] = []
        place, token = 0, longest[0]
        while place < size:
            while token >= 0:
                end = place + self._length[token]
                if not dead[end] and (not out or self._fit(out[-1], token)):
                    break
                token = self._shorter[token]
            if token >= 0:
                out.append(token)
                place = end
                token = longest[place] if place < size else -1
            else:
                dead[place] = 1
                token = out.pop()
                place -= self._length[token]
                token = self._shorter[token]
        return out

    def split(self, text: str) -> list[str]:
        return (self._pattern if NOT_LATIN.search(text) else self._latin_parts).findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces, known = self.split(text), self._pieces
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self._most_cached:
            known.clear()
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = array("I", self.encode_piece(piece.encode())).tobytes()
        ids = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > 100:
                del known[piece]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, own, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents' ids: doc_id, ids (binary, little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            ids = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _columns(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes that ids stand for: doc_id, decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            texts = [codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass."""
    return _columns(docs).mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
