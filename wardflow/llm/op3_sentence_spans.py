"""Removing passages that repeat across documents, by hashes of sliding sentence spans.

A text is cut into sentences (up to the next run of ``.``, ``!``, ``?``, their like in other scripts
or line feeds, with the white space after it), and sentences of ``WINDOW`` or more words into pieces:
of every ``WINDOW`` words in a row in a sentence, the one with the lowest hash begins a piece. Of every
piece the shortest span that starts there, and the shortest that ends there, with at least
``MIN_SENTENCES`` pieces and ``MIN_CHARS`` characters is hashed. Spans that occur more than once, in any
documents, are found by a global join on the hash; the first of them, by document and place, stays. A
piece is removed where a span that is not the first covers it.

The borders inside a sentence depend on the words around them alone, never on where the sentence
starts or how long it is, and no piece is longer than ``WINDOW`` words (but before the first and after
the last border). So a passage that stands in two documents has the same pieces in both, with or
without signs between its words, except for fewer than ``WINDOW`` words at either end; what lies between is
covered whole where it is long enough for a span, as every piece begins or ends a span inside it.
Those words at the ends may be merged with the text around, and then stay. A repeat below
``MIN_CHARS`` characters and a short common line are kept. In scripts without blanks each character
counts as a word.

The hash of a span that half of the corpus shares meets no task of its own: counts and first places are
combined before the shuffle, and the join has one row on its other side.

Defined results: NULL text stays NULL, empty text stays empty; a text that loses all its pieces is
empty, its row stays; rows equal in doc_id and text count as one document and are treated alike; a row
without doc_id goes by a negative number made from its text; an empty table gives no rows; columns
other than the text (and n_chars, where there is one) are left as they are.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.session import materialize

MIN_SENTENCES = 2
MIN_CHARS = 100
WINDOW = 12
_HASHES_KEPT = 30_000

# Signs that end a sentence, and the scripts that write no blanks between words.
_END = r".!?\n\u2026\u2028\u2029\u061f\u06d4\u0964\u0965\u3002\uff01\uff0e\uff1f\uff61"
_UNSPACED = (
    r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    r"\U00020000-\U0003ffff"
)
_SENTENCE = re.compile(rf"[^{_END}]*[{_END}]+\s*|[^{_END}]+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"\s*(?:[^\s{_UNSPACED}]+|[{_UNSPACED}])\s*|\s+")


class _Hashes(dict):
    """Hashes of words, the white space around them left out."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _HASHES_KEPT:
            self.clear()
        own = self[word] = zlib.crc32(word.strip().encode("utf-8", "surrogatepass"))
        return own


_hash_of = _Hashes().__getitem__


def borders(hashes: list[int]) -> list[int]:
    """Places of the last lowest hash of every ``WINDOW`` hashes in a row."""
    if len(hashes) < WINDOW:
        return []
    found = []
    window = hashes[:WINDOW]
    least = min(window)
    at = WINDOW - 1 - window[::-1].index(least)
    while True:
        found.append(at)
        after = hashes[at + 1 : at + WINDOW]
        if after and min(after) <= least:
            at = next(i for i, own in enumerate(after, at + 1) if own <= least)
            least = hashes[at]
        elif at + WINDOW < len(hashes):
            window = hashes[at + 1 : at + WINDOW + 1]
            least = min(window)
            at = at + WINDOW - window[::-1].index(least)
        else:
            return found


def _words(sentence: str, unspaced: bool) -> tuple[list[str], int]:
    """The words of a sentence, and the number of blanks to count after each: 1 where they hold no white space."""
    if unspaced:
        return _WORD.findall(sentence), 0
    words = sentence.split()
    if len(words) < WINDOW:
        return words, 0
    plain = " ".join(words)
    if sentence.startswith(plain) and not sentence[len(plain) :].strip(" \n"):
        return words, 1
    return _WORD.findall(sentence), 0


def sentences(text: str) -> list[str]:
    """Sentences, long ones in pieces, with what follows them; joined they are the text."""
    out = []
    unspaced = not text.isascii() and _ANY_UNSPACED.search(text) is not None
    for sentence in _SENTENCE.findall(text):
        words, blank = _words(sentence, unspaced) if len(sentence) >= WINDOW else ((), 0)
        if len(words) < WINDOW:
            out.append(sentence)
            continue
        at = 0
        for first, last in itertools.pairwise([0, *borders(list(map(_hash_of, words)))]):
            if last > first:
                size = sum(map(len, words[first:last])) + blank * (last - first)
                out.append(sentence[at : at + size])
                at += size
        out.append(sentence[at:])
    return out


def spans(parts: list[str]) -> list[tuple[int, int, int]]:
    """(first sentence, last sentence, hash) of the shortest spans that start or end at each sentence."""
    import xxhash

    plain = [part.strip() for part in parts]
    own = b"".join(xxhash.xxh3_64_digest(part.encode()) for part in plain)
    upto = [0]
    for part in plain:
        upto.append(upto[-1] + len(part))
    found = set()
    last = 0
    for first in range(len(plain)):
        last = max(last, first + MIN_SENTENCES - 1)
        while last < len(plain) and upto[last + 1] - upto[first] < MIN_CHARS:
            last += 1
        if last == len(plain):
            break
        found.add((first, last))
    first = 0
    for last in range(MIN_SENTENCES - 1, len(plain)):
        while first <= last - MIN_SENTENCES and upto[last + 1] - upto[first + 1] >= MIN_CHARS:
            first += 1
        if upto[last + 1] - upto[first] >= MIN_CHARS:
            found.add((first, last))
    return [(a, b, xxhash.xxh3_64_intdigest(own[8 * a : 8 * b + 8]) - (1 << 63)) for a, b in sorted(found)]


def _keyed(docs: DataFrame) -> DataFrame:
    """_key, _text_hash, text and the whole row as _row."""
    text = F.col("text").cast("string")
    hashed = F.xxhash64(text)
    own = -1 - hashed.bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), own).alias("_key"),
        hashed.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("_text_hash"),
        text.alias("text"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
    )


def _all_spans(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.extend((key, text_hash, a, b, h) for a, b, h in spans(sentences(text or "")))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), ["_key", "_text_hash", "a", "b", "h"])

    return keyed.select("_key", "_text_hash", "text").mapInArrow(run, "_key long, _text_hash int, a int, b int, h long")


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` materialized; the shuffle files that led to it go at once, not when the driver next collects garbage."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        return materialize(df, label)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans that are not the first of their kind, per row: _key, _text_hash, spans (array of a, b)."""
    every = materialize(_all_spans(_keyed(docs)), "spans")
    place = F.struct("_key", "_text_hash", "a")
    kinds = every.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("_last")).where("first <> _last")
    kinds = _written(kinds.select("h", "first"), "repeated-spans")
    later = every.join(kinds, "h").where(place != F.col("first"))
    spans_of = later.groupBy("_key", "_text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return _written(spans_of, "later-spans")


def _without(text: str, covered: list[dict]) -> tuple[str, int, int]:
    """The text without the covered sentences, their number, and that of all sentences."""
    parts = sentences(text)
    gone = bytearray(len(parts))
    for span in covered:
        gone[span["a"] : span["b"] + 1] = b"\1" * (span["b"] + 1 - span["a"])
    return "".join(part for part, lost in zip(parts, gone) if not lost), sum(gone), len(parts)


def remove_repeated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; with ``counts`` also n_sentences and n_removed."""
    joined = _keyed(docs).join(repeated_spans(docs), ["_key", "_text_hash"], "left")
    joined = joined.select("_row", "spans")
    docs_columns = docs.columns
    at_text, at_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = T.StructType(docs.schema.fields + [T.StructField(x, T.LongType()) for x in ("n_sentences", "n_removed") if counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, sizes, removed, number = columns[at_text].to_pylist(), [], [], []
            for i, covered in enumerate(batch.column(1).to_pylist()):
                lost, n = 0, None
                if covered:
                    texts[i], lost, n = _without(texts[i], covered)
                number.append(len(sentences(texts[i] or "")) if counts and n is None else n)
                removed.append(lost)
                sizes.append(None if texts[i] is None else len(texts[i]))
            columns[at_text] = pa.array(texts, pa.string())
            if at_chars is not None:
                columns[at_chars] = pa.array(sizes).cast(columns[at_chars].type)
            names = list(docs_columns)
            if counts:
                columns += [pa.array(number, pa.int64()), pa.array(removed, pa.int64())]
                names = [*names, "n_sentences", "n_removed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text without repeated passages, n_sentences, n_removed."""
    return remove_repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), True)

