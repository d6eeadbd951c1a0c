"""Packing documents into sequences of a fixed length by bin completion.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. How pieces go
into sequences depends on their lengths alone, and there are at most ``capacity`` different ones. So
the plan is made for the whole corpus at once from the number of pieces of each length: it is a list
of patterns (how often, which lengths side by side), and pieces find their place by the rank they
have among those of their length. The driver sees the counts, never the pieces.

The plan is searched by bin completion. Best-fit decreasing gives the first incumbent. Then the
largest length left is completed again and again: the undominated fillings of the room beside it are
enumerated, the one that wastes least is tried first, and it is used as often as the counts allow. A
branch is left when its waste could not give fewer sequences than the incumbent, which always is the
best plan found. The search ends at the lower bound or after ``most_nodes`` patterns; what is left
unsearched costs sequences, never pieces.

Defined results: NULL text counts as empty (a piece with the end id alone); repeated rows are packed
each on their own; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.tables import BLOCK_ROWS, block_of, rank_in_blocks
from wardflow.llm.tokens import encoder, ended
from wardflow.session import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), the largest first
Plan = list[tuple[int, Pattern]]  # how many sequences, of which pattern

_NODES_A_FILLING = 100


def plan_size(plan: Plan) -> int:
    return sum(times for times, _ in plan)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: all tokens, or what cannot share with lengths over half, count."""
    best = -(-sum(size * n for size, n in counts.items()) // capacity)
    large = sorted((size, n) for size, n in counts.items() if 2 * size > capacity)
    n_large = sum(n for _, n in large)
    tokens = room = at = 0
    # Lengths under ``small`` are left out; of the large ones, those up to capacity - small have room.
    for small in sorted((size for size in counts if 2 * size <= capacity), reverse=True):
        tokens += small * counts[small]
        while at < len(large) and large[at][0] <= capacity - small:
            room += (capacity - large[at][0]) * large[at][1]
            at += 1
        best = max(best, n_large + max(0, -((room - tokens) // capacity)))
    return max(best, n_large)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Each length, the largest first, goes to the fullest sequences that have room for it."""
    by_room: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left and (rooms := [room for room in by_room if room >= size]):
            room = min(rooms)
            times, pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            # A sequence takes as many of this length as fit: it stays the fullest that has room.
            each = min(room // size, left)
            used = min(times, left // each)
            if used < times:
                by_room[room].append((times - used, pattern))
            by_room[room - each * size].append((used, (*pattern, (size, each))))
            left -= used * each
        if left:
            each = capacity // size
            if left // each:
                by_room[capacity - each * size].append((left // each, ((size, each),)))
            if left % each:
                by_room[capacity - left % each * size].append((1, ((size, left % each),)))
    return [entry for entries in by_room.values() for entry in entries]


def _dominated(filling: tuple[int, ...], waste: int, rising: list[int], free: dict[int, int]) -> bool:
    """Whether a larger free length could stand for one or two lengths of the filling."""
    parts = set(filling) | {a + b for i, a in enumerate(filling) for b in filling[i + 1 :]}
    return any(
        free[size] for part in parts for size in rising[bisect_right(rising, part) : bisect_right(rising, part + waste)]
    )


def fillings(room: int, counts: dict[int, int], rising: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` as (waste, lengths), the least waste first.

    ``rising`` are the lengths that may have a count. A filling without waste ends the enumeration:
    found with the largest lengths first, it leaves the small ones for rooms that need them.
    """
    found: dict[tuple[int, ...], int] = {}
    free = {size: counts[size] for size in rising}
    nodes = 0

    def extend(highest: int, left: int, chosen: tuple[int, ...]) -> bool:
        """Enumerate from ``chosen`` with lengths up to ``highest``; True once nothing is wasted."""
        nonlocal nodes
        nodes += 1
        if not left or left <= highest and free.get(left, 0):
            found[(*chosen, left) if left else chosen] = 0
            return True
        at = bisect_right(rising, min(highest, left)) - 1
        fits = False
        while at >= 0 and (nodes < _NODES_A_FILLING or not fits):
            size = rising[at]
            if free[size]:
                fits = True
                free[size] -= 1
                perfect = extend(size, left - size, (*chosen, size))
                free[size] += 1
                if perfect:
                    return True
            at -= 1
        if not fits:
            found[chosen] = left
        return False

    extend(room, room, ())
    kept = []
    for waste, filling in sorted((waste, filling) for filling, waste in found.items()):
        for size in filling:
            free[size] -= 1
        if not kept or not _dominated(filling, waste, rising, free):
            kept.append((waste, filling))
        for size in filling:
            free[size] += 1
        if not waste:
            break
    return kept


def bin_completion(counts: dict[int, int], capacity: int, most_nodes: int = 4_000) -> Plan:
    """The best plan found for ``counts`` pieces of each length; see the module."""
    counts = {size: n for size, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    least = lower_bound(counts, capacity)
    total = sum(size * n for size, n in counts.items())
    left, order = dict(counts), sorted(counts)
    waste = nodes = 0
    path: list[tuple[int, Pattern, int]] = []
    pending: list[Iterator[tuple[int, Pattern, int]]] = []

    def choices() -> Iterator[tuple[int, Pattern, int]]:
        rising = [size for size in order if left[size]]
        largest = rising[-1]
        left[largest] -= 1
        options = fillings(capacity - largest, left, rising[: bisect_right(rising, capacity - largest)])
        left[largest] += 1
        for lost, filling in options:
            uses: dict[int, int] = defaultdict(int)
            for size in (largest, *filling):
                uses[size] += 1
            yield min(left[size] // n for size, n in uses.items()), tuple(uses.items()), lost

    def undo() -> None:
        nonlocal waste
        times, pattern, lost = path.pop()
        waste -= times * lost
        for size, n in pattern:
            left[size] += times * n

    if counts:
        pending.append(choices())
    while pending and plan_size(best) > least and nodes < most_nodes:
        if len(path) == len(pending):
            undo()
        allowed = (plan_size(best) - 1) * capacity - total
        step = next(pending[-1], None)
        if step is None or waste + step[2] * step[0] > allowed:
            pending.pop()  # later fillings of this room waste as much or more
            continue
        times, pattern, lost = step
        nodes += 1
        waste += times * lost
        for size, n in pattern:
            left[size] -= times * n
        path.append(step)
        if any(left.values()):
            pending.append(choices())
        else:
            best = [(times, pattern) for times, pattern, _ in path]
    return best


def _cut(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, "blanks", 4).encode_all
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for part in encode_all(batch.column("text")):
                ids, places = ended(*part, end_id)
                rows = []
                for begin, stop in zip(places.tolist(), places[1:].tolist()):
                    n = stop - begin
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        own = ids[begin + a : begin + b]
                        rows.append((doc_ids[at], piece, a, b - a, zlib.crc32(own), *[own.tobytes()] * keep_ids))
                    at += 1
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), kinds)), names)

    return run


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bits)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity, keep_ids), kinds)


def place_pieces(pieces: DataFrame, capacity: int = 1024, most_nodes: int = 4_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ids_crc32), which must be a stored table."""
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places, sequence = [], 0
    taken: dict[int, int] = defaultdict(int)
    for times, pattern in bin_completion(counts, capacity, most_nodes):
        offset = 0
        for size, n in pattern:
            places.append((size, taken[size], taken[size] + times * n, n, sequence, offset))
            taken[size] += times * n
            offset += size * n
        sequence += times
    # One row for each length of each pattern: bounded by the number of lengths, not of pieces.
    plan = spark.createDataFrame(places, "length long, _lo long, _hi long, _each long, _first long, _at long")
    blocks = max(1, -(-max(counts.values(), default=0) // BLOCK_ROWS))
    keyed = pieces.withColumn("_block", block_of(blocks, "doc_id", "piece", "ids_crc32"))
    ranked = rank_in_blocks(keyed, ["length"], ["_block"], ["doc_id", "piece", "ids_crc32"], "_rank")
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= _lo AND _rank < _hi")
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"),
        (F.col("_at") + (F.col("_rank") - F.col("_lo")) % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False, most_nodes: int = 4_000
) -> DataFrame:
    """All pieces of ``docs`` with their places: see ``cut_documents`` and ``place_pieces``."""
    pieces = materialize(cut_documents(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    return place_pieces(pieces, capacity, most_nodes)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences as (sequence_id, ids, doc_ids, offsets); needs pieces that kept their ids.

    A group is one sequence, so it never holds more than ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return placed.groupBy("sequence_id").agg(
        whole.alias("ids"), parts["doc_id"].alias("doc_ids"), parts["offset"].alias("offsets")
    )
