"""Declared rules as set tests: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.text import folded


def duplicate_keys(df: DataFrame, keys: Sequence[str], nulls: str = "one") -> DataFrame:
    """Keys held by more than one row, with their count.

    ``nulls``: "one" lets a single NULL pass like any value, "ignore" skips NULL keys.
    """
    rows = df.dropna(subset=list(keys)) if nulls == "ignore" else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def outside_list(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose text is not in the list; case is ignored and NULL passes."""
    return df.filter(~folded(column).isin(*[a.lower() for a in allowed]))


def outside_range(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break at least one named rule, with the names in ``broken``.

    A rule is the condition that must hold; an unknown result passes.
    """
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    )
    return df.withColumn("broken", F.array_join(broken, ",")).filter("broken <> ''")


def unordered_pairs(df: DataFrame, low: str, high: str, strict: bool = True) -> DataFrame:
    """Rows in which ``high`` does not come after ``low``."""
    wrong = F.col(high) <= F.col(low) if strict else F.col(high) < F.col(low)
    return df.filter(wrong)


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of NULLs per column: one row each."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, deleted_key: str) -> DataFrame:
    """Children left after their parents were deleted."""
    keys = deleted.select(F.col(deleted_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, child_key: str, deleted_key: str) -> DataFrame:
    """Children with references to deleted parents emptied."""
    keys = deleted.select(F.col(deleted_key).alias(child_key)).distinct().withColumn("_gone", F.lit(True))
    return child.join(keys, child_key, "left").select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == child_key else F.col(c) for c in child.columns]
    )


def invoice_balance(invoice: DataFrame, details: DataFrame) -> DataFrame:
    """Invoices whose header amount differs from the sum of their lines."""
    sums = details.groupBy("invoice_id").agg(F.sum("total").alias("lines_total"))
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        invoice.select("invoice_id", "paid_money")
        .join(sums, "invoice_id", "left")
        .withColumn("lines_total", F.coalesce("lines_total", zero))
        .filter(F.col("paid_money") != F.col("lines_total"))
    )
