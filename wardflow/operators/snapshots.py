"""Next state of a table: append, replace keys, update from a join, upsert, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in state.schema]))


def delete_keys(state: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return state.join(keys.select(*on), list(on), "left_anti")


def replace_keys(state: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop every row of the keys in ``rows``, then add ``rows``."""
    return append(delete_keys(state, rows, on), rows)


def update_from(state: DataFrame, source: DataFrame, on: Sequence[str], sets: dict[str, Column | str]) -> DataFrame:
    """Overwrite columns from ``source`` (unique on the key); other rows stay.

    A ``sets`` value is a column of ``source`` or an expression over both sides,
    where source columns are written ``new_<column>``.
    """
    on = list(on)
    renamed = source.select(*on, *[F.col(c).alias(f"new_{c}") for c in source.columns if c not in on])
    joined = state.join(renamed.withColumn("_hit", F.lit(True)), on, "left")
    columns = []
    for field in state.schema:
        if field.name in sets:
            value = sets[field.name]
            value = F.col(f"new_{value}") if isinstance(value, str) else value
            chosen = F.when(F.col("_hit"), value).otherwise(F.col(field.name))
            columns.append(chosen.cast(field.dataType).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return joined.select(*columns)


def upsert(state: DataFrame, source: DataFrame, on: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Matched keys take ``source`` values (except ``keep``), new keys are added.

    Both sides must be unique on the key.
    """
    on = list(on)
    left = state.select(*on, F.struct(*state.columns).alias("_old"))
    right = source.select(*on, F.struct(*source.columns).alias("_new"))
    merged = left.join(right, on, "full_outer")
    columns = []
    for field in state.schema:
        old = F.col(f"_old.{field.name}")
        if field.name not in source.columns:
            value = old
        elif field.name in keep:
            value = F.when(F.col("_old").isNotNull(), old).otherwise(F.col(f"_new.{field.name}"))
        else:
            value = F.when(F.col("_new").isNotNull(), F.col(f"_new.{field.name}")).otherwise(old)
        columns.append(value.cast(field.dataType).alias(field.name))
    return merged.select(*columns)


def set_by_keys(df: DataFrame, column: str, key: str, values: dict) -> DataFrame:
    """Overwrite ``column`` with a literal per set of keys; other rows stay.

    ``values`` maps a tuple of keys to the literal.
    """
    current = F.col(column)
    kind = df.schema[column].dataType
    expr = None
    for keys, literal in values.items():
        test = F.col(key).isin(*keys)
        expr = F.when(test, F.lit(literal)) if expr is None else expr.when(test, F.lit(literal))
    return df if expr is None else df.withColumn(column, expr.otherwise(current).cast(kind))


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames of equal columns and name their origin in ``tag``."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
