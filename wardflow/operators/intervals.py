"""Interval tests that say whether a partner exists, without listing pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.text import ColumnLike, col
from wardflow.operators.scan import running
from wardflow.session import materialize


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive overlap of two intervals."""
    return (a_start <= b_end) & (b_start <= a_end)


def on_duty(clock: ColumnLike, start: ColumnLike, end: ColumnLike, wrap: bool = False) -> Column:
    """Whether a time of day lies in a slot; ``wrap`` lets a slot pass midnight.

    Without ``wrap`` a slot ending at 00:00 never matches. With it, a slot of equal
    start and end matches nothing.
    """
    clock, start, end = col(clock), col(start), col(end)
    if not wrap:
        return clock.between(start, end)
    return (
        F.when(start < end, clock.between(start, end))
        .when(start > end, (clock >= start) | (clock <= end))
        .otherwise(F.lit(False))
    )


def self_conflicts(df: DataFrame, keys: Sequence[str], start: str, end: str, id_column: str) -> DataFrame:
    """Ids of rows that overlap another row of the same keys.

    Sorted by start, a row overlaps an earlier one if the highest end so far reaches
    its start, and a later one if the lowest start still to come is not after its end.
    """
    scanned = running(
        df.select(*keys, start, end, id_column),
        keys,
        [start, id_column],
        {"_earlier_end": ("max", F.col(end))},
        inclusive=False,
        following={"_later_start": ("min", F.col(start))},
    )
    hit = (F.col("_earlier_end") >= F.col(start)) | (F.col("_later_start") <= F.col(end))
    return scanned.filter(F.coalesce(hit, F.lit(False))).select(id_column)


def overlapping(requests: DataFrame, slots: DataFrame, keys: Sequence[str], start: str, end: str, id_column: str) -> DataFrame:
    """Ids of requests that overlap at least one slot of the same keys.

    A slot touches [start, end] exactly if, among the slots starting no later than
    the request's end, the highest end reaches the request's start.
    """
    keys = list(keys)
    marks = slots.select(
        *keys,
        F.col(start).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(end).alias("_slot_end"),
        F.lit(None).cast(requests.schema[start].dataType).alias("_from"),
        F.lit(None).cast(requests.schema[id_column].dataType).alias(id_column),
    ).groupBy(*keys, "_at", "_kind", "_from", id_column).agg(F.max("_slot_end").alias("_slot_end"))
    asks = requests.select(
        *keys,
        F.col(end).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col(start).alias("_from"),
        F.col(id_column),
        F.lit(None).cast(slots.schema[end].dataType).alias("_slot_end"),
    )
    line = marks.unionByName(asks)
    scanned = running(line, keys, ["_at", "_kind", id_column], {"_reach": ("max", F.col("_slot_end"))})
    return scanned.filter((F.col("_kind") == 1) & (F.col("_reach") >= F.col("_from"))).select(id_column)


# Blocks of the day: one second, 64 seconds, 64 times 64 seconds.
_BLOCK_BITS = 6
_BLOCK_LEVELS = 3
_DAY_END = 86_399


def _day_blocks(start: Column, end: Column) -> Column:
    """The seconds from start to end as the fewest blocks (level, number), large ones inside, small ones at the ends.

    At most 63 blocks of a size are needed at either end, and a second lies in one block of each size.
    """

    def bounds(level: int) -> tuple[Column, Column]:
        size = F.lit(1 << _BLOCK_BITS * level)
        return F.ceil(start / size).cast("long"), F.floor((end + 1) / size).cast("long")

    def run(level: int, low: Column, high: Column) -> Column:
        numbers = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("_level"), n.alias("_block")))

    parts = []
    for level in range(_BLOCK_LEVELS):
        low, high = bounds(level)
        if level + 1 == _BLOCK_LEVELS:
            parts.append(run(level, low, high))
            continue
        inner_low, inner_high = bounds(level + 1)
        inside = inner_low < inner_high
        parts.append(run(level, low, F.when(inside, inner_low * (1 << _BLOCK_BITS)).otherwise(high)))
        parts.append(run(level, F.when(inside, inner_high * (1 << _BLOCK_BITS)).otherwise(high), high))
    return F.concat(*parts)


def lowest_on_duty(
    requests: DataFrame,
    slots: DataFrame,
    keys: Sequence[str],
    clock: str,
    start: str,
    end: str,
    pick: Sequence[str],
    name: str,
    wrap: bool = False,
) -> DataFrame:
    """Add ``name``: the lowest ``pick`` (a struct) among the slots of the keys that cover the second ``clock``.

    Every slot is cut into blocks of the day of three sizes, and the lowest pick is kept for each
    block, so what is stored grows neither with the people nor with the pairs of slots. A request joins the
    block of each size that its second lies in, on equal values, and takes the lowest of the three picks.
    """
    keys = list(keys)
    begin, finish = F.col(start).cast("long"), F.col(end).cast("long")
    shapes = slots.groupBy(*keys, start, end).agg(F.min(F.struct(*pick)).alias("_pick"))
    whole = F.array(F.struct(begin.alias("_from"), finish.alias("_to")))
    if wrap:
        # A slot that passes midnight is two spans of the day.
        evening = F.struct(begin.alias("_from"), F.lit(_DAY_END).cast("long").alias("_to"))
        morning = F.struct(F.lit(0).cast("long").alias("_from"), finish.alias("_to"))
        span = F.when(begin < finish, whole).when(begin > finish, F.array(evening, morning))
    else:
        span = F.when(begin <= finish, whole)
    spans = shapes.select(*keys, "_pick", F.explode(span).alias("_span")).select(*keys, "_pick", "_span.*")
    covered = spans.select(*keys, "_pick", F.explode(_day_blocks(F.col("_from"), F.col("_to"))).alias("_at"))
    best = materialize(covered.groupBy(*keys, "_at._level", "_at._block").agg(F.min("_pick").alias("_pick")), "duty")
    found = requests
    for level in range(_BLOCK_LEVELS):
        blocks = best.filter(F.col("_level") == level).select(*keys, "_block", F.col("_pick").alias(f"_pick{level}"))
        block = F.expr(f"shiftright(cast(`{clock}` as bigint), {_BLOCK_BITS * level})")
        found = found.withColumn("_block", block).join(blocks, [*keys, "_block"], "left").drop("_block")
    lowest = F.least(*[F.col(f"_pick{level}") for level in range(_BLOCK_LEVELS)])
    return found.select(*requests.columns, lowest.alias(name))
