"""Small helpers shared by the operators: tables, scratch copies, ranks in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows that one task sorts at most when ranks or running sums are worked out.
BLOCK_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_of(n_blocks: int, *columns: str) -> Column:
    """Block of a row by the hash of ``columns``: even whatever the keys of the rows are."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_blocks))


def rank_in_blocks(
    df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], name: str, size: Column | None = None
) -> DataFrame:
    """Add ``name``: the number (or, with ``size``, the sum of ``size``) of rows before each row of its keys.

    Rows of a key are ordered by ``block``, then by ``order``. Only a block is ever sorted in one task;
    the blocks of a key are counted first, and the counts before a block are added to the places in it.
    """
    size = F.lit(1) if size is None else size
    at = [*keys, *block]
    sized = df.withColumn("_size", size.cast("long"))
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy(*at).agg(F.sum("_size").alias("_sum"))
    bases = bases.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return placed.join(bases, at).withColumn(name, F.col("_base") + F.col("_inside")).drop("_size", "_inside", "_base")
