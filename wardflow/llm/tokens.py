"""Exact token ids of whole texts by the tokenizers library, one distinct piece at a time.

``Encoder.encode`` gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives, several
times faster on long corpora. A text is cut where the tokenizer itself always cuts, and the ids of
a distinct piece are worked out once per worker:

* ``words``: the tokenizer drops white space, so every blank or line feed is a cut;
* ``blanks``: a blank (or line feed) belongs to what follows it, and of a run of them only the
  last one does. A text with any other white space is one piece.

A new piece is normalised and split by the tokenizer's own normalizer and pre-tokenizer (by the
same pattern in ``re`` where it is all Latin), and its parts are merged by the tokenizer's model.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than blank and line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0  -     　]")
# Texts that Arrow may not cut at every blank and line feed: other white space, or several in a row.
_ODD_SPACE = r"[\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
_BYTES_AT_ONCE = 4 << 20
_ASCII_SPACE = "\t\r\x0b\x0c"
_LONGEST_KEPT = 100
_PIECE = re.compile(r"[ \n]?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")

# Code points below this one are handled in ``re``: none of them composes with another, and their
# lower case does not depend on what stands next to them.
_LATIN_END = 0x250
NOT_LATIN = re.compile(f"[^\0-{chr(_LATIN_END - 1)}]")


def _category(initial: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == initial)


_L, _N, _S = _category("L"), _category("N"), "\t-\r \x85\xa0"
# The split patterns of the two public vocabularies, the first also as it is published.
BLANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_PARTS = {
    "blanks": re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
    ),
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _has_other_space(text: str) -> bool:
    if text.isascii():
        return any(space in text for space in _ASCII_SPACE)
    return _OTHER_SPACE.search(text) is not None


class _Known(dict):
    """Ids of pieces: at most ``most`` recent ones, and those that were recent before."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self._encode, self._most, self._before = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._before.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= _LONGEST_KEPT:
            if len(self) >= self._most:
                self._before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes each."""

    def __init__(self, path: str, cut: str, width: int, most_kept: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._normalizer, self._splitter, self._model = whole.normalizer, whole.pre_tokenizer, whole.model
        self._lower = whole.normalizer is not None
        self._latin_parts = LATIN_PARTS[cut]
        self._alphabet = byte_alphabet()
        self._code = {2: "H", 4: "I"}[width]
        self._pieces = _Known(self._encode_piece, most_kept)
        self._after_blank = _Known(self._encode_after_blank, most_kept)
        self.encode = {"words": self._encode_words, "blanks": self._encode_blanks}[cut]

    def _encode_words(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def _encode_blanks(self, text: str) -> bytes:
        if _has_other_space(text):
            return self._encode_piece(text)
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return b"".join(map(self._pieces.__getitem__, _PIECE.findall(text)))
        # Single separators only: a line feed begins a piece, and so does every blank.
        out = []
        for at, line in enumerate(text.split("\n")):
            words = line.split(" ")
            first = words.pop(0)
            out.append(self._pieces["\n" + first if at else first])
            out.append(b"".join(map(self._after_blank.__getitem__, words)))
        return b"".join(out)

    def _encode_after_blank(self, word: str) -> bytes:
        if word.isalpha() and not NOT_LATIN.search(word):
            return self._encode_part(" " + word)
        return self._encode_piece(" " + word)

    def _encode_piece(self, piece: str) -> bytes:
        if NOT_LATIN.search(piece):
            piece = self._normalizer.normalize_str(piece) if self._lower else piece
            return b"".join([self._encode_part(piece[a:b]) for _, (a, b) in self._splitter.pre_tokenize_str(piece)])
        lower = piece.lower() if self._lower else piece
        if lower == piece and piece.isalpha():
            return self._encode_part(piece)
        parts = self._latin_parts.findall(lower)
        if len(parts) == 1 and parts[0] == piece:
            return self._encode_part(piece)
        # The parts of a piece are pieces themselves, most of them known.
        return b"".join([self._after_blank[x[1:]] if x[0] == " " else self._pieces[x] for x in parts])

    def _encode_part(self, part: str) -> bytes:
        mapped = (part if part.isascii() else part.encode().decode("latin-1")).translate(self._alphabet)
        return array(self._code, [token.id for token in self._model.tokenize(mapped)]).tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of many texts, some megabytes at a time: (ids, place of each text's first id and of the end).

        Words are split and told apart by Arrow, so each distinct one of a part is looked up once.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        first = 0
        while first < len(texts):
            begin = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, begin + _BYTES_AT_ONCE, "right")))
            yield self._encode_part_of(texts.slice(first, last - first))
            first = last
            # The worker serves other stages too: give back what the part needed.
            pa.default_memory_pool().release_unused()

    def _encode_part_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = {}
        if self.encode == self._encode_blanks:
            marked = pc.match_substring_regex(texts, _ODD_SPACE)
            if pc.any(marked).as_py():
                odd = {int(i): self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(marked)}
                texts = pc.if_else(marked, "", texts)
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        n_words = np.asarray(split.value_lengths(), dtype=np.int64)
        starts = np.cumsum(n_words) - n_words
        coded = split.flatten().dictionary_encode()
        which = np.array(coded.indices)
        words = coded.dictionary.to_pylist()
        if self.encode == self._encode_blanks:
            # A text's first word has no blank before it.
            heads = [words[i] for i in which[starts]]
            ids = [self._pieces[word] if word[:1] == "\n" else self._after_blank[word] for word in words]
            ids.extend([self._pieces[word] for word in heads])
            which[starts] = np.arange(len(words), len(ids))
        else:
            ids = [self._pieces[word] for word in words]
        kind = np.dtype(f"<u{array(self._code).itemsize}")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
        flat = np.frombuffer(b"".join(ids), kind)
        taken = lengths[which]
        shift = (np.cumsum(lengths) - lengths)[which] - (np.cumsum(taken) - taken)
        out = flat[np.repeat(shift, taken) + np.arange(taken.sum())]
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(taken, starts))]) if len(starts) else np.zeros(1, np.int64)
        if odd:
            whole = [np.frombuffer(odd[i], kind) if i in odd else out[offsets[i] : offsets[i + 1]] for i in range(len(starts))]
            out, offsets = np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])])
        return out, offsets


def ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new places."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


@lru_cache(maxsize=4)
def encoder(path: str, cut: str, width: int) -> Encoder:
    """The worker's encoder for a tokenizer file; Python workers serve many tasks."""
    return Encoder(path, cut, width)
