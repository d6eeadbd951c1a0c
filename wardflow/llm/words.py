"""Words of whole texts by byte classes, and sets of query texts in blocks of bounded size.

Both word patterns of the corpus searches keep every byte of a character beyond ASCII and some ASCII
signs, so words are found on the UTF-8 bytes of a whole Arrow column at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wardflow.operators import scan
from wardflow.session import materialize

# Text that is split into words at once.
SLICE_BYTES = 4 << 20
# Query texts that are broadcast at once; a longer single text is a block of its own.
BLOCK_BYTES = 4 << 20


def byte_table(ascii_signs: str) -> np.ndarray:
    """What each byte becomes: 0 between words, A-Z in lower case, bytes beyond ASCII as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 0
    for sign in ascii_signs:
        table[ord(sign)] = ord(sign.lower())
    return table


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORD_BYTES = byte_table(_LETTERS + "0123456789")


@dataclass
class Words:
    """Words of some texts, one after the other."""

    words: pa.StringArray
    counts: np.ndarray  # words of each text
    begins: np.ndarray  # first byte of each word in its text
    ends: np.ndarray  # byte after its last one

    @property
    def firsts(self) -> np.ndarray:
        """Number of the first word of each text."""
        return np.cumsum(self.counts) - self.counts

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and the place of each text's first byte and of the end; NULL has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _word_starts(data: np.ndarray, places: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as ``table`` maps them, and which of them begin a word."""
    mapped = table[data]
    inside = mapped != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    # Words end where their text does.
    firsts = places[:-1][places[:-1] < places[1:]]
    start[firsts] = inside[firsts]
    return mapped, start


def count_words(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    data, places = _bytes_of(texts)
    starts = np.flatnonzero(_word_starts(data, places, table)[1])
    return np.diff(np.searchsorted(starts, places))


def words_of(texts: pa.Array, table: np.ndarray) -> Words:
    data, places = _bytes_of(texts)
    mapped, start = _word_starts(data, places, table)
    inside = mapped != 0
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | start[1:]
    stops = np.flatnonzero(stop) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(mapped[inside]))
    counts = np.diff(np.searchsorted(starts, places))
    shift = np.repeat(places[:-1], counts)
    return Words(words, counts, starts - shift, stops - shift)


def slices(texts: pa.Array, at_once: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a column into runs of rows with about ``at_once`` bytes of text: (first row, row after the last)."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    first = 0
    while first < len(texts):
        begin = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, begin + at_once, "right")))
        yield first, last
        first = last


def query_blocks(items: DataFrame, id_column: str, at_once: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """The query texts as lists of (id, text) with at most ``at_once`` bytes, or one longer text, each.

    The size is summed up first; where all fit there is one list. Texts that are NULL are left out.
    """
    wanted = items.select(F.col(id_column).alias("id"), "text").where("text IS NOT NULL")
    sized = wanted.withColumn("size", F.octet_length("text").cast("long") + 16)
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= at_once:
        yield sized.select("id", "text").collect()
        return
    placed = scan.running(sized, [], ["id", "text"], {"before": ("sum", F.col("size"))}, inclusive=False)
    block = F.floor(F.coalesce("before", F.lit(0)) / at_once)
    blocks = materialize(placed.select("id", "text", block.alias("block")), "query_blocks")
    for number in sorted(r[0] for r in blocks.select("block").distinct().collect()):
        yield blocks.where(F.col("block") == number).select("id", "text").collect()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns ``taken``."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
