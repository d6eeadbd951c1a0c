"""Text built from many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def concat_by(
    df: DataFrame, keys: Sequence[str], value: Column, separator: str, order: Sequence[str], name: str, *others: Column
) -> DataFrame:
    """Delimited list per key, in the given order, and ``others`` aggregated along with it."""
    entry = F.struct(*order, value.alias("_text"))
    ordered = F.sort_array(F.collect_list(entry))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda e: e["_text"]), separator).alias(name), *others
    )


def _concat_few(
    df: DataFrame, keys: Sequence[str], value: Column, separator: str, order: Sequence[str], name: str, others: dict[str, Column]
) -> DataFrame:
    """``concat_by`` for very many keys of few rows: rows are sorted once, and no table of lists is kept."""
    along = Window.partitionBy(*keys).orderBy(*order)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = {"_texts": F.collect_list(value), **others}
    told = df.select(*keys, F.row_number().over(along).alias("_row"), *[kept.over(whole).alias(n) for n, kept in lists.items()])
    return told.where("_row = 1").select(*keys, F.array_join("_texts", separator).alias(name), *others)


def report_lines(
    df: DataFrame, keys: Sequence[str], line: Column, order: Sequence[str], name: str, *others: Column, few: dict[str, Column] | None = None
) -> DataFrame:
    """Whole multi-line report per key: every line ends with a carriage return.

    With ``few``, which names what is aggregated along with it, keys are taken to be very many, of few lines each.
    """
    if few is not None:
        return _concat_few(df, keys, F.concat(line, F.chr(F.lit(13))), "", order, name, few)
    return concat_by(df, keys, F.concat(line, F.chr(F.lit(13))), "", order, name, *others)
