"""Running values along a total order, split evenly whatever the keys look like.

A window partitioned by a hot key would sort that key's rows in one task. Here the
rows are range-partitioned by (keys, order), so a hot key spreads over many ranges;
each range is scanned on its own, and the few keys that cross a range border get the
value carried over from the ranges before. At most one key crosses each border, so
the table of carried values never has more rows than there are shuffle partitions.

Rows that know their stretch of the order (``in_order``, ``block_of``) are brought together by stretch instead:
what the stretches before add up to per key comes as one more row per key and stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from wardflow.session import materialize

_POSITION_BITS = 33
# A block of the order holds up to 1 << _BLOCK_BITS numbers.
_BLOCK_BITS = 16
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def _final_merge(kind: str) -> str:
    return "sum" if kind == "count" else kind


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    following: dict[str, tuple[str, Column]] | None = None,
    inclusive_following: bool = False,
    block: str | None = None,
) -> DataFrame:
    """Add ``name -> running kind(expr)`` per ``keys`` along ``order``.

    ``order`` must be a total order within the keys and keys must not be NULL.
    ``values`` runs from the first row, ``following`` from the last row backwards.
    With ``inclusive=False`` the current row is left out (NULL on the first row).

    ``block`` names a column of consecutive stretches of the order, none larger than a task can take. The result
    is then partitioned by it, so that rows of one place in the order can be grouped without being moved again.
    ``df`` is read twice and had better be written; values are sums, maxima or minima up to the current row.
    """
    if block:
        return _running_in_blocks(df, list(keys), list(order), values, block)
    following = following or {}
    keys, order = list(keys), list(order)
    inputs = {f"_in_{name}": expr for name, (_, expr) in {**values, **following}.items()}
    ranged = df.withColumns(inputs).repartitionByRange(*keys, *order)
    chunks = materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "scan")

    carried = _carried(chunks, keys, values, following)
    result = chunks.join(F.broadcast(carried), [*keys, "_chunk"], "left") if keys else chunks.join(
        F.broadcast(carried), "_chunk", "left"
    )
    forward = Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    backward = Window.partitionBy("_chunk", *keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive_following else -1
    )
    for name, (kind, _) in values.items():
        local = _AGGREGATE[kind](F.col(f"_in_{name}")).over(forward)
        result = result.withColumn(f"_local_{name}", local)
    for name, (kind, _) in following.items():
        local = _AGGREGATE[kind](F.col(f"_in_{name}")).over(backward)
        result = result.withColumn(f"_local_{name}", local)
    merged = {
        name: _merge(kind, F.col(f"_carry_{name}"), F.col(f"_local_{name}"))
        for name, (kind, _) in {**values, **following}.items()
    }
    return result.select(*df.columns, *[expr.alias(name) for name, expr in merged.items()])


def _running_in_blocks(df: DataFrame, keys: list[str], order: list[str], values: dict, block: str) -> DataFrame:
    inputs = {f"_in_{name}": (_AGGREGATE[kind], expr) for name, (kind, expr) in values.items()}
    rows = df.withColumns({name: expr for name, (_, expr) in inputs.items()})
    parts = rows.groupBy(*keys, block).agg(*[merge(name).alias(name) for name, (merge, _) in inputs.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, block, *[merge(name).over(before).alias(name) for name, (merge, _) in inputs.items()])
    # What is carried into a block goes ahead of the rows of its key.
    whole = rows.withColumn("_own", F.lit(True)).unionByName(carried.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, block).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [_AGGREGATE[kind](f"_in_{name}").over(so_far).alias(name) for name, (kind, _) in values.items()]
    return whole.repartition(block).select(*df.columns, "_own", *found).where("_own").drop("_own")


def _carried(chunks: DataFrame, keys: list[str], values: dict, following: dict) -> DataFrame:
    """Per (key, chunk): what the earlier (or later) chunks of the key add up to."""
    source = chunks
    if keys:
        edges = chunks.groupBy("_chunk").agg(
            F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")
        )
        crossing = edges.select("hi.*").intersect(edges.select("lo.*"))
        source = chunks.join(F.broadcast(crossing), keys, "left_semi")
    partial = source.groupBy(*keys, "_chunk").agg(
        *[
            _AGGREGATE[kind](F.col(f"_in_{name}")).alias(f"_part_{name}")
            for name, (kind, _) in {**values, **following}.items()
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    columns = [
        _AGGREGATE[_final_merge(kind)](F.col(f"_part_{name}")).over(window).alias(f"_carry_{name}")
        for window, group in ((before, values), (after, following))
        for name, (kind, _) in group.items()
    ]
    return partial.select(*keys, "_chunk", *columns)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Row numbers 1, 2, 3 … along ``order`` (per ``keys``), without one big task."""
    if keys:
        return running(df, keys, order, {name: ("count", F.lit(1))})
    # The id of a sorted range is (range << 33) + position, so no window is needed:
    # the sizes of the ranges before, one row per range, give the rest.
    chunks = in_order(df, order, "_at", "numbered")
    chunk = F.shiftright("_at", _POSITION_BITS)
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + 1
    sizes = chunks.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    located = chunks.withColumns({"_chunk": chunk, "_position": position})
    return located.join(F.broadcast(offsets), "_chunk").select(
        *df.columns, (F.col("_position") + F.col("_offset")).alias(name)
    )


def in_order(df: DataFrame, order: Sequence[str], name: str, label: str = "in_order") -> DataFrame:
    """Numbers that grow along ``order`` but leave gaps; written, so that they stay."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(placed.withColumn(name, F.monotonically_increasing_id()), label)


def block_of(number: str) -> Column:
    """The stretch of the order that a number given by ``in_order`` is in."""
    return F.shiftright(number, _BLOCK_BITS)


def fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[dict], object],
    step: Callable[[object, dict], tuple[object, dict | None]],
    finish: Callable[[dict, object], dict | None],
    schema: str,
) -> DataFrame:
    """Fold the rows of each key in order with a function whose steps do not compose (each rounds, say).

    ``start`` gives the state before a key's first row, ``step`` the next state and a result row or None,
    ``finish`` a last result from the first row and the final state. Rows pass through a task sorted and one
    by one, so a task holds a single state however many rows a key has; one pass, no driver rounds.
    """
    keys = list(keys)
    kinds = T._parse_datatype_string(schema)
    arrow, names = to_arrow_schema(kinds), [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = state = None
        out: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict.fromkeys(names), **row} for row in out], arrow)

        for part in batches:
            out = []
            for row in part.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if first is not None and (last := finish(first, state)):
                        out.append(last)
                    at, first, state = key, row, start(row)
                state, told = step(state, row)
                if told:
                    out.append(told)
            yield batch()
        out = [last] if first is not None and (last := finish(first, state)) else []
        yield batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def highest_id(state: DataFrame, id_column: str) -> Column:
    """Highest id in use, 0 for an empty table, as a scalar subquery."""
    return state.agg(F.coalesce(F.max(F.col(id_column).cast("long")), F.lit(0).cast("long"))).scalar()


def with_next_ids(
    rows: DataFrame, state: DataFrame, id_column: str, order: Sequence[str], state_id: str | None = None
) -> DataFrame:
    """Give ``rows`` the ids after the highest in ``state``, in the given order."""
    numbered = number_rows(rows, order, "_place")
    base = highest_id(state, state_id or id_column)
    return numbered.withColumn(id_column, F.col("_place") + base).drop("_place")


def spread_dates(df: DataFrame, order: Sequence[str], as_of: Column, column: str, days: int = 10) -> DataFrame:
    """Set ``column`` to ``as_of`` minus 0 … days-1 days, in turn along ``order``."""
    numbered = number_rows(df, order, "_place")
    back = ((F.col("_place") - 1) % days).cast("int")
    return numbered.withColumn(column, F.date_sub(as_of.cast("date"), back)).drop("_place")
