"""Benchmark decontamination: words of documents that lie in an n-gram of a benchmark item.

The windows of the items (``n`` words each; an item with fewer words is one window) become a hash
table that is broadcast: benchmark words have numbers, a window is a run of such numbers, kept under a
64-bit hash of them. A task numbers the words of its texts by the same vocabulary, hashes the windows
made of known words only, looks them up, and then compares the word numbers themselves, so what is
reported is exact. The benchmark is broadcast in blocks of a checked size (``words.query_blocks``):
usually one; with more of them, documents pass by the blocks in turn and keep what was found before.

Defined results: NULL or empty text has no words and no hits; repeated rows are marked each on their
own; an item that is NULL, empty or without words has no window; an item without id marks words but is
not among the items found; items of one id count as one; an empty benchmark marks nothing, no
documents give no rows; columns other than the text are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.words import WORD_BYTES, Words, fresh, query_blocks, slices, words_of
from wardflow.session import materialize

# Words of a window.
N = 10
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass
class Windows:
    """Windows of one length: ``hashes`` ascend, ``begins`` are their places in the benchmark's words."""

    factor: int
    hashes: np.ndarray
    begins: np.ndarray
    groups: np.ndarray  # which list of items holds the window


@dataclass
class Benchmark:
    """A block of items, ready to be broadcast."""

    vocabulary: pa.Array
    codes: np.ndarray
    by_length: dict[int, Windows]
    groups: list[np.ndarray]  # lists of item numbers
    names: list[str]  # ids of the items, sorted as strings


def _hash(codes: np.ndarray, begins: np.ndarray, length: int, factor: int) -> np.ndarray:
    total = np.zeros(len(begins), np.uint64)
    for i in range(length):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(factor) + codes[begins + i].astype(np.uint64) + np.uint64(1)
    return total


def _windows(codes: np.ndarray, begins: np.ndarray, owners: np.ndarray, length: int, group_no: dict) -> Windows:
    """Each distinct window once, with the items that hold it."""
    rows = np.ascontiguousarray(codes[begins[:, None] + np.arange(length)])
    _, first, which = np.unique(rows.view([("", rows.dtype)] * length).ravel(), return_index=True, return_inverse=True)
    held = np.unique(np.stack([which, owners], axis=1), axis=0)
    bounds = np.searchsorted(held[:, 0], np.arange(len(first) + 1))
    groups = np.empty(len(first), np.int64)
    for i in range(len(first)):
        key = held[bounds[i] : bounds[i + 1], 1].tobytes()
        groups[i] = group_no.setdefault(key, len(group_no))
    distinct = begins[first]
    for factor in _FACTORS:
        hashes = _hash(codes, distinct, length, factor)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) == len(hashes):
            return Windows(factor, hashes[order], distinct[order], groups[order])
    raise ValueError("window hashes collide for every factor")


def build(items: list[Row], n: int = N) -> Benchmark:
    """The hash table of some items' windows."""
    names = sorted({str(r["id"]) for r in items if r["id"] is not None})
    number = {name: i for i, name in enumerate(names)}
    found = words_of(pa.array([r["text"] for r in items], pa.string()), WORD_BYTES)
    coded = found.words.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int32)
    begins, owners = defaultdict(list), defaultdict(list)
    for row, first, count in zip(items, found.firsts.tolist(), found.counts.tolist()):
        length = min(n, count)
        if length:
            places = np.arange(first, first + count - length + 1)
            begins[length].append(places)
            owners[length].append(np.full(len(places), -1 if row["id"] is None else number[str(row["id"])]))
    group_no: dict[bytes, int] = {}
    by_length = {
        length: _windows(codes, np.concatenate(begins[length]), np.concatenate(owners[length]), length, group_no)
        for length in sorted(begins)
    }
    groups = [np.frombuffer(key, np.int64) for key in group_no]
    return Benchmark(coded.dictionary, codes, by_length, [g[g >= 0] for g in groups], names)


@dataclass
class Hits:
    words: Words
    hit: np.ndarray  # which words lie in a window
    items: dict[int, np.ndarray]  # text -> numbers of the items found in it


def find(texts: pa.Array, benchmark: Benchmark) -> Hits:
    """Words of ``texts`` inside an occurrence of a window, and the items whose windows occur."""
    found = words_of(texts, WORD_BYTES)
    total = len(found.words)
    known = pc.index_in(found.words, value_set=benchmark.vocabulary)
    codes = np.asarray(pc.fill_null(known, -1), dtype=np.int32)
    unknown = np.concatenate([[0], np.cumsum(codes < 0)])
    text_of = found.text_of
    change = np.zeros(total + 1, np.int64)
    pairs = []
    for length, windows in benchmark.by_length.items():
        if total < length:
            continue
        whole = (unknown[length:] == unknown[:-length]) & (text_of[length - 1 :] == text_of[: total - length + 1])
        begins = np.flatnonzero(whole)
        hashes = _hash(codes, begins, length, windows.factor)
        at = np.minimum(np.searchsorted(windows.hashes, hashes), len(windows.hashes) - 1)
        likely = np.flatnonzero(windows.hashes[at] == hashes)
        begins, at = begins[likely], at[likely]
        same = np.ones(len(begins), bool)
        for i in range(length):
            same &= codes[begins + i] == benchmark.codes[windows.begins[at] + i]
        begins, at = begins[same], at[same]
        change[begins] += 1
        change[begins + length] -= 1
        pairs.append(np.stack([text_of[begins], windows.groups[at]], axis=1))
    items: dict[int, list[np.ndarray]] = defaultdict(list)
    if pairs:
        for text, group in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[text].append(benchmark.groups[group])
    joined = {text: np.unique(np.concatenate(lists)) for text, lists in items.items()}
    return Hits(found, np.cumsum(change[:-1]) > 0, joined)


def _runs(hit: np.ndarray) -> np.ndarray:
    """(first word, word after the last) of each run of hit words."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def _pass(benchmark: Broadcast, text: str, new: Marks, kept: list[str]) -> Callable:
    """A pass over rows: adds to their runs of hit words and items found what ``benchmark`` holds."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = benchmark.value
        for batch in batches:
            for first, last in slices(batch[text]):
                part = batch.slice(first, last - first)
                found = find(part[text], block)
                counts = found.words.counts
                old_runs, old_items = part[new.runs].to_pylist(), part[new.items].to_pylist()
                n_hit, runs, items = [], [], []
                for i, start in enumerate(found.words.firsts.tolist()):
                    hit = found.hit[start : start + counts[i]]
                    if old_runs[i]:
                        hit = hit.copy()
                        for a, b in np.frombuffer(old_runs[i], "<i8").reshape(-1, 2):
                            hit[a:b] = True
                    n_hit.append(int(hit.sum()))
                    runs.append(_runs(hit).astype("<i8").tobytes() if n_hit[-1] else b"")
                    names = [block.names[k] for k in found.items.get(i, ())]
                    items.append(sorted({*old_items[i], *names}) if old_items[i] else names)
                columns = dict(zip(part.schema.names, part.columns)) | {
                    new.n_words: pa.array(counts, pa.int64()),
                    new.n_hit: pa.array(n_hit, pa.int64()),
                    new.runs: pa.array(runs, pa.binary()),
                    new.items: pa.array(items, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in kept})

    return mark


class Marks(NamedTuple):
    """Names of the columns that ``mark`` adds."""

    n_words: str
    n_hit: str
    runs: str  # (first word, word after the last) of each run of hit words, as little-endian 64-bit numbers
    items: str  # ids of the items found, sorted as strings


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N, keep_text: bool = True) -> tuple[DataFrame, Marks]:
    """``docs`` with the columns of ``Marks``; their names avoid those of ``docs``."""
    new = Marks(*(fresh(name, docs.columns) for name in Marks._fields))
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    marked = docs.withColumns({new.n_words: zero, new.n_hit: zero, new.runs: F.lit(b""), new.items: none})
    context = docs.sparkSession.sparkContext
    blocks = query_blocks(benchmark, "item_id")
    rows, after, first = next(blocks, []), next(blocks, None), True
    while rows is not None:
        if not first:
            marked = materialize(marked, "marked")
        kept = [c for c in marked.columns if keep_text or after is not None or c != "text"]
        schema = T.StructType([marked.schema[c] for c in kept])
        marked = marked.mapInArrow(_pass(context.broadcast(build(rows, n)), "text", new, kept), schema)
        rows, after, first = after, next(blocks, None), False
    return marked, new


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: its words, those hit, and the items whose windows occur in it."""
    marked, new = mark(docs.select("doc_id", "text"), benchmark, n, keep_text=False)
    return marked.select(
        "doc_id",
        F.col(new.n_words).alias("n_words"),
        F.col(new.n_hit).alias("n_hit"),
        F.size(new.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(new.items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col(new.n_hit) > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, n: int = N) -> DataFrame:
    """Documents of which at most the share ``most`` of their words is hit."""
    marked, new = mark(docs, benchmark, n)
    return marked.where(F.col(new.n_hit) <= F.col(new.n_words) * F.lit(most)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Documents without the runs of words that are hit, from the first letter of a run to its last one."""
    marked, new = mark(docs, benchmark, n)
    kept = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch["text"], batch[new.runs].to_pylist()
            changed = [i for i, found in enumerate(runs) if found]
            if changed:
                out = texts.to_pylist()
                for i in changed:
                    words, raw = words_of(texts.slice(i, 1), WORD_BYTES), out[i].encode()
                    spans = np.frombuffer(runs[i], "<i8").reshape(-1, 2)
                    begins = [0, *words.ends[spans[:, 1] - 1].tolist()]
                    ends = [*words.begins[spans[:, 0]].tolist(), len(raw)]
                    out[i] = b"".join(raw[a:b] for a, b in zip(begins, ends)).decode()
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_pydict({c: texts if c == "text" else batch[c] for c in kept})

    return marked.mapInArrow(cut, docs.schema)


CONTAMINATION_SQL = """
WITH words AS (
  SELECT d.rowid_ AS doc_row, d.doc_id, regexp_extract_all(
    translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d
), item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_row, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_row, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
), hits AS (
  SELECT DISTINCT d.doc_row, d.i, d.size, b.item_id FROM doc_windows d JOIN item_windows b USING (size, gram)
), hit_words AS (
  SELECT doc_row, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_row, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_row, i, size FROM hits))
  GROUP BY doc_row
), hit_items AS (
  SELECT doc_row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_row) LEFT JOIN hit_items USING (doc_row)
"""
