"""Ranked lexical search: the best documents of each query text, from K2-treaps over blocks of documents.

The index is a table with one row for each block of documents. A block is a grid of terms by documents
whose points carry *impacts*, what an occurrence count adds to a score for each unit of a term's weight.
The grid is kept as a compressed quadtree: level by level, every cell that holds a point has a mask of its
four quarters and the greatest impact in it (stored as its drop below the cell above). Frequent terms
come first in the rows and short documents first in the columns, so that neighbours are alike.

A query text is a set of rows. Its row paths go down the tree together: a state is a range of documents
with, for every term, the cell of that range on the term's path; a cell that is missing ends the path of
that term there. The weights times the impact maxima of a state's cells bound the score of every document in
the range. States are taken best bound first, some hundreds at a time; a state whose bound is below the
``k``-th best score found so far is dropped, and a state of one document has the exact score. A task keeps
the best documents it found over all its blocks, so later blocks are cut earlier. The best of all
tasks are ranked with row numbers in two steps, so no task sees more than ``k`` rows of an item from each
task before it. Query texts are broadcast in blocks of a checked size (``words.query_blocks``).

Scores are those of ``SCORE`` below, in whole numbers: every document that holds a term of the item is
either scored or ruled out by a bound, so the result is exact.

Defined results: NULL, empty and wordless texts hold no term, are not counted as documents and are never
found; an item without terms that occur has no rows; repeated documents are ranked each on their own,
equal scores by ascending doc_id, NULL first; repeated items are answered each on their own; empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardflow.llm.words import WORD_BYTES, count_words, query_blocks, slices, words_of
from wardflow.session import scratch_path

# Documents, and bytes of text, of a block at most (a longer single text is a block of its own).
BLOCK_DOCS = 4096
BLOCK_TEXT = 16 << 20
# Cells looked at in one step of the descent.
_CELLS_AT_ONCE = 1 << 14
_TASKS_A_FIRST_ROUND = 256

# Fixed values of the score: weight scale, saturation and length share, in thousandths and hundredths.
_WEIGHT_SCALE = 1000
_IMPACT_SCALE = 1_000_000_000
_TF_FACTOR, _LENGTH_FACTOR = 1000, 20
_LENGTH_PERCENT = 50


@dataclass(frozen=True)
class Statistics:
    """Documents with at least one term, and all their terms with repeats."""

    n_docs: int
    n_terms: int

    def weight(self, held_by: int) -> int:
        """Weight of a term that ``held_by`` documents hold."""
        return math.floor(_WEIGHT_SCALE * math.log((2 * self.n_docs + 2) / (2 * held_by + 1)))

    def length_norm(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and _LENGTH_PERCENT * int(lengths.max()) * self.n_docs >= 1 << 63:
            raise OverflowError("a document is too long for 64-bit scores in a corpus of this size")
        return 100 - _LENGTH_PERCENT + _LENGTH_PERCENT * lengths * self.n_docs // max(1, self.n_terms)

    def impact(self, counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return _IMPACT_SCALE * counts // (_TF_FACTOR * counts + _LENGTH_FACTOR * norms)


def statistics(docs: DataFrame) -> Statistics:
    """Counted over the whole texts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for first, last in slices(batch["text"]):
                lengths = count_words(batch["text"].slice(first, last - first), WORD_BYTES)
                n_docs += int(np.count_nonzero(lengths))
                n_terms += int(lengths.sum())
        yield pa.RecordBatch.from_pydict({"docs": pa.array([n_docs], pa.int64()), "terms": pa.array([n_terms], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "docs long, terms long")
    total = counted.agg(F.sum("docs"), F.sum("terms")).first()
    return Statistics(total[0] or 0, total[1] or 0)


# The tree of one block


def _spread(values: np.ndarray) -> np.ndarray:
    """Bit i of every value at bit 2 i."""
    out = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = (out | out << np.uint64(shift)) & np.uint64(mask)
    return out


_N_QUARTERS = np.array([bin(mask).count("1") for mask in range(16)], np.int32)
# Quarters of a mask that come before quarter q: _BEFORE[mask, q].
_BEFORE = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)], np.int32)


@dataclass
class Treap:
    """Cells of all levels in one numbering, from the root down; the last level has the points."""

    levels: int
    masks: np.ndarray  # quarters that hold points: 2 * (lower half of the rows) + (right half of the columns)
    first_child: np.ndarray
    maxima: np.ndarray  # greatest impact of each cell; one more at the end, 0, for cells that are missing

    @classmethod
    def of_points(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> Treap:
        levels = max(1, int(max(rows.max(), columns.max())).bit_length())
        place = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(place)
        cells, most = place[order], impacts[order]
        masks, maxima = [], [most]
        for _ in range(levels):
            above = cells >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            quarters = np.left_shift(1, (cells & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(quarters, starts))
            most = np.maximum.reduceat(most, starts)
            maxima.append(most)
            cells = above[starts]
        return cls._numbered(levels, np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]))

    @classmethod
    def _numbered(cls, levels: int, inner: np.ndarray, maxima: np.ndarray) -> Treap:
        children = _N_QUARTERS[inner]
        masks = np.zeros(len(maxima) + 1, np.uint8)
        masks[: len(inner)] = inner
        first_child = np.zeros(len(maxima) + 1, np.int32)
        first_child[: len(inner)] = 1 + np.cumsum(children) - children
        return cls(levels, masks, first_child, np.append(maxima, 0).astype(np.int64))

    def packed(self) -> tuple[bytes, bytes]:
        """Masks two a byte, and drops of the maxima below those of the cells above, compressed."""
        inner = self.masks[: np.count_nonzero(self.masks)]
        even = np.append(inner, np.zeros(len(inner) % 2, np.uint8))
        parents = np.repeat(np.arange(len(inner)), _N_QUARTERS[inner])
        drops = self.maxima[:-1].copy()
        drops[1:] = self.maxima[parents] - drops[1:]
        pack = pa.Codec("zstd")
        sizes = np.array([self.levels, len(inner), len(drops)], "<i8").tobytes()
        masks = (even[::2] << 4 | even[1::2]).astype(np.uint8).tobytes()
        return sizes + pack.compress(masks, asbytes=True), pack.compress(drops.astype("<i4").tobytes(), asbytes=True)

    @classmethod
    def unpacked(cls, masks: bytes, drops: bytes) -> Treap:
        levels, n_inner, n_cells = np.frombuffer(masks[:24], "<i8").tolist()
        pack = pa.Codec("zstd")
        pairs = np.frombuffer(pack.decompress(masks[24:], (n_inner + 1) // 2, asbytes=True), np.uint8)
        inner = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n_inner]
        below = np.frombuffer(pack.decompress(drops, 4 * n_cells, asbytes=True), "<i4")
        maxima = np.empty(n_cells, np.int64)
        maxima[0] = below[0]
        begin, end, at = 0, 1, 1
        for _ in range(levels):
            parents = np.repeat(maxima[begin:end], _N_QUARTERS[inner[begin:end]])
            maxima[at : at + len(parents)] = parents - below[at : at + len(parents)]
            begin, end, at = end, at + len(parents), at + len(parents)
        return cls._numbered(levels, inner, maxima)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns with the ``k`` best sums of weight times impact over ``rows``, with all ties of the last, and the sums.

        Only sums of ``least`` or more count.
        """
        levels, missing = self.levels, len(self.maxima) - 1
        lower = (rows[None, :] >> (levels - 1 - np.arange(levels))[:, None] & 1).astype(np.int8)
        at_once = max(16, _CELLS_AT_ONCE // max(1, len(rows)))
        # States not yet looked at: cells on the rows' paths, level, number of the document range, bound.
        cells = np.zeros((1, len(rows)), np.int32)
        level, ranges = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bounds = np.array([int(self.maxima[0]) * int(weights.sum())])
        found_columns, found_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(bounds):
            if len(bounds) > at_once:
                order = np.argpartition(-bounds, at_once)
                now, later = order[:at_once], order[at_once:]
            else:
                now, later = np.arange(len(bounds)), np.empty(0, np.int64)
            masks, first = self.masks[cells[now]], self.first_child[cells[now]]
            rows_half = lower[level[now]]
            parts = []
            for right in (0, 1):
                quarter = 2 * rows_half + right
                child = np.where(masks >> quarter & 1, first + _BEFORE[masks, quarter], missing)
                bound = self.maxima[child] @ weights
                good = np.flatnonzero(bound >= least)
                parts.append((child[good], level[now][good] + 1, 2 * ranges[now][good] + right, bound[good]))
            new = [np.concatenate(x) for x in zip(*parts)]
            done = new[1] == levels
            if done.any():
                found_columns = np.concatenate([found_columns, new[2][done]])
                found_scores = np.concatenate([found_scores, new[3][done]])
                if len(found_scores) >= k:
                    least = max(least, int(-np.partition(-found_scores, k - 1)[k - 1]))
                    kept = found_scores >= least
                    found_columns, found_scores = found_columns[kept], found_scores[kept]
            old = [x[later] for x in (cells, level, ranges, bounds)]
            cells, level, ranges, bounds = (np.concatenate([a, b[~done]]) for a, b in zip(old, new))
            likely = bounds >= least
            cells, level, ranges, bounds = cells[likely], level[likely], ranges[likely], bounds[likely]
        return found_columns, found_scores


# The index


def _index_row(texts: list[pa.Array], ids: list[pa.Array], stats: Statistics) -> pa.RecordBatch | None:
    """A block of documents as one row: ids, terms with the number of documents that hold them, and the tree."""
    codes, docs, lengths, terms = [], [], [], []
    n_docs = 0
    for part in texts:
        for first, last in slices(part):
            found = words_of(part.slice(first, last - first), WORD_BYTES)
            coded = found.words.dictionary_encode()
            # Occurrences of a document's terms, counted a slice at a time.
            wide = max(1, len(coded.dictionary))
            keys, counts = np.unique(found.text_of * wide + np.asarray(coded.indices, np.int64), return_counts=True)
            codes.append((coded.dictionary, keys % wide, counts))
            docs.append(keys // wide + n_docs)
            lengths.append(found.counts)
            terms.append(coded.dictionary)
            n_docs += len(found.counts)
    all_terms = pa.chunked_array(terms, pa.string()).unique()
    if not len(all_terms):
        return None
    term_of = [np.asarray(pc.index_in(own, value_set=all_terms), np.int64)[at] for own, at, _ in codes]
    term, doc = np.concatenate(term_of), np.concatenate(docs)
    counts, length = np.concatenate([c for _, _, c in codes]), np.concatenate(lengths)
    impacts = stats.impact(counts, stats.length_norm(length)[doc])
    held_by = np.bincount(term, minlength=len(all_terms))
    by_row, by_column = np.argsort(-held_by, kind="stable"), np.argsort(length, kind="stable")
    row_of, column_of = np.empty_like(by_row), np.empty_like(by_column)
    row_of[by_row], column_of[by_column] = np.arange(len(by_row)), np.arange(len(by_column))
    masks, drops = Treap.of_points(row_of[term], column_of[doc], impacts).packed()
    doc_ids = pa.concat_arrays(ids).take(pa.array(by_column))
    lists = {
        "doc_ids": pa.ListArray.from_arrays([0, len(doc_ids)], doc_ids),
        "terms": pa.ListArray.from_arrays([0, len(all_terms)], all_terms.take(pa.array(by_row))),
        "held_by": pa.ListArray.from_arrays([0, len(all_terms)], pa.array(held_by[by_row], pa.int64())),
    }
    return pa.RecordBatch.from_pydict(lists | {"masks": pa.array([masks]), "drops": pa.array([drops])})


def build_index(docs: DataFrame, stats: Statistics, path: str | None = None) -> DataFrame:
    """All documents as an index table, written to ``path`` (else to the scratch folder) and read from there."""
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, n_docs, n_bytes = [], [], 0, 0
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), dtype=np.int64))
            while at < batch.num_rows:
                begin = sizes[at - 1] if at else 0
                room = int(np.searchsorted(sizes, begin + BLOCK_TEXT - n_bytes, "right"))
                end = min(batch.num_rows, at + BLOCK_DOCS - n_docs, room)
                if end > at or not n_docs:
                    end = max(end, at + 1)
                    texts.append(batch["text"].slice(at, end - at))
                    ids.append(batch["doc_id"].slice(at, end - at))
                    n_docs, n_bytes = n_docs + end - at, n_bytes + int(sizes[end - 1] - begin)
                    at = end
                if at < batch.num_rows or n_docs >= BLOCK_DOCS:
                    if (row := _index_row(texts, ids, stats)) is not None:
                        yield row
                    texts, ids, n_docs, n_bytes = [], [], 0, 0
        if n_docs and (row := _index_row(texts, ids, stats)) is not None:
            yield row

    schema = T.StructType(
        [
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("held_by", T.ArrayType(T.LongType())),
            T.StructField("masks", T.BinaryType()),
            T.StructField("drops", T.BinaryType()),
        ]
    )
    path = path or scratch_path(spark, "search_index")
    index = docs.select("doc_id", "text").mapInArrow(build, schema)
    # Rows are some megabytes each: look at the size of a row group after each few of them.
    options = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "4"}
    index.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


# The search


@dataclass
class Queries:
    """A block of query texts: the terms of all, and which of them each text has."""

    terms: pa.Array
    terms_of: list[np.ndarray]

    @classmethod
    def of(cls, items: list[Row]) -> Queries:
        found = words_of(pa.array([r["text"] for r in items], pa.string()), WORD_BYTES)
        coded = found.words.dictionary_encode()
        codes, firsts = np.asarray(coded.indices, np.int64), found.firsts.tolist()
        return cls(coded.dictionary, [np.unique(codes[a : a + n]) for a, n in zip(firsts, found.counts.tolist())])


def _held_by(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How many documents hold each of some terms."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            at = pc.index_in(batch["terms"].flatten(), value_set=wanted.value)
            known = np.asarray(pc.is_valid(at))
            held = np.asarray(batch["held_by"].flatten())[known]
            total += np.bincount(np.asarray(at.drop_null()), held, len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    parts = index.select("terms", "held_by").mapInArrow(count, "term long, n long")
    out = np.zeros(len(terms), np.int64)
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():  # at most the terms of one block of queries
        out[term] = n
    return out


def _searcher(queries: Broadcast, weights: Broadcast, k: int, id_type: pa.DataType) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight_of = queries.value, weights.value
        # The best of this task: (score, NULL first, doc_id), per item.
        best: list[list[tuple]] = [[] for _ in wanted.terms_of]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree = Treap.unpacked(row["masks"][0].as_py(), row["drops"][0].as_py())
                ids = row["doc_ids"].flatten()
                by_id = pc.array_sort_indices(ids) if not ids.null_count else pc.sort_indices(ids, null_placement="at_start")
                rank = np.empty(len(ids), np.int64)
                rank[np.asarray(by_id)] = np.arange(len(ids))
                at = np.asarray(pc.fill_null(pc.index_in(wanted.terms, value_set=row["terms"].flatten()), -1), np.int64)
                for number, terms in enumerate(wanted.terms_of):
                    terms = terms[at[terms] >= 0]
                    if not len(terms):
                        continue
                    kept = best[number]
                    least = max(1, kept[-1][0]) if len(kept) == k else 1
                    columns, scores = tree.best(at[terms], weight_of[terms], k, least)
                    first = np.lexsort([rank[columns], -scores])[:k]
                    names = ids.take(pa.array(columns[first])).to_pylist()
                    new = [(s, name) for s, name in zip(scores[first].tolist(), names)]
                    if new:
                        best[number] = heapq.nsmallest(k, [*kept, *new], key=_order)
        rows = [(number, name, score) for number, kept in enumerate(best) for score, name in kept]
        yield pa.RecordBatch.from_pydict(
            {
                "item": pa.array([r[0] for r in rows], pa.int64()),
                "doc_id": pa.array([r[1] for r in rows], id_type),
                "score": pa.array([r[2] for r in rows], pa.int64()),
            }
        )

    return search


def _order(entry: tuple) -> tuple:
    score, name = entry
    return (-score, name is not None, name if name is not None else 0)


def search(index: DataFrame, items: DataFrame, stats: Statistics, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = index.sparkSession
    context = spark.sparkContext
    id_field = T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType)
    item_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), id_field, T.StructField("score", T.LongType())])
    ranked = None
    for rows in query_blocks(items, "item_id"):
        queries = Queries.of(rows)
        weights = np.array([stats.weight(n) for n in _held_by(index, queries.terms).tolist()], np.int64)
        id_type = _arrow_type(id_field.dataType)
        run = _searcher(context.broadcast(queries), context.broadcast(weights), k, id_type)
        found = index.select("doc_ids", "terms", "masks", "drops").mapInArrow(run, schema)
        found = found.withColumn("_round", F.floor(F.spark_partition_id() / _TASKS_A_FIRST_ROUND))
        for keys in (["item", "_round"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(number, row["id"]) for number, row in enumerate(rows)],
            T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]),
        )
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        ranked = part if ranked is None else ranked.unionAll(part)
    if ranked is None:
        empty = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), id_field, schema[2]])
        return spark.createDataFrame([], empty)
    return ranked


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index all documents, then search them for every item."""
    stats = statistics(docs)
    return search(build_index(docs, stats), items, stats, k)


SEARCH_SQL = """
WITH doc_terms AS (
  SELECT doc_row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS doc_row FROM documents)
), item_terms AS (
  SELECT DISTINCT item_row, item_id, term FROM (
    SELECT item_row, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS item_row FROM benchmark))
), lengths AS (
  SELECT doc_row, count(*) AS n FROM doc_terms GROUP BY doc_row
), totals AS (
  SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
), counts AS (
  SELECT doc_row, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
), scores AS (
  SELECT item_row, item_id, doc_row, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_row), totals
  GROUP BY item_row, item_id, doc_row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
