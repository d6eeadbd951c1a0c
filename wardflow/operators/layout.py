"""Tables laid out by key range, of which a batch rewrites only the ranges it touches.

A table is a Parquet folder partitioned by ``key_range``: the number of the range of ``width`` keys a row's whole-number
key falls into. The state functions of ``snapshots`` (replace, update, upsert, delete) run on the touched ranges alone;
files of other ranges are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import materialize

RANGE = "key_range"
# Range of rows without a key.
NO_KEY = -(1 << 62)


def range_of(key: str, width: int) -> Column:
    """Number of the range of ``width`` keys that ``key`` falls into; whole-number arithmetic, so exact for every key."""
    number = F.col(key).cast("long")
    inside = F.pmod(number, F.lit(width).cast("long"))
    return F.coalesce(F.call_function("div", number - inside, F.lit(width).cast("long")), F.lit(NO_KEY).cast("long"))


def width_for(df: DataFrame, key: str, n_ranges: int) -> int:
    """Width that deals the keys of ``df`` into at most ``n_ranges`` ranges, plus one at either end."""
    number = F.col(key).cast("decimal(20,0)")
    span = df.agg((F.max(number) - F.min(number) + 1).alias("span")).first()["span"]
    return max(1, -(-int(span or 1) // n_ranges))


def _write(df: DataFrame, path: str, key: str, width: int, mode: str) -> None:
    # Rebalanced, so that a range with many rows is written by several tasks.
    laid_out = df.withColumn(RANGE, range_of(key, width)).hint("rebalance", RANGE)
    writer = laid_out.write.mode(mode).partitionBy(RANGE)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _ranges(df: DataFrame) -> set[int]:
    """Distinct ranges: at most as many as the table has folders, which Spark lists in the driver anyway."""
    return {row[RANGE] for row in df.select(RANGE).distinct().collect()}


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def create(df: DataFrame, path: str, key: str, width: int) -> None:
    """Write ``df`` as a new table; an existing one is never overwritten."""
    _write(df, path, key, width, "errorifexists")


def read(like: DataFrame, path: str) -> DataFrame:
    """All rows of a table, with the columns and types of ``like``."""
    return _read(like, path).drop(RANGE)


def _read(like: DataFrame, path: str) -> DataFrame:
    schema = like.select(*like.columns, F.lit(0).cast("long").alias(RANGE)).schema
    return like.sparkSession.read.schema(schema).parquet(path)


def rewrite(
    path: str,
    like: DataFrame,
    batch: DataFrame,
    key: str,
    width: int,
    change: Callable[[DataFrame, DataFrame], DataFrame],
) -> int:
    """Apply ``change(state, batch)`` to the ranges that the keys of ``batch`` fall into; returns how many these are.

    ``change`` gets the state of those ranges only and returns their next state, with the columns of ``like``. Rows it
    puts into other ranges are refused before anything is written. Ranges left without rows lose their folder. An empty
    batch changes nothing. The batch is read twice. Each range is replaced on its own: after a lost driver the same batch is run again, which
    gives the same state for replace, update, upsert and delete.
    """
    spark = batch.sparkSession
    touched = _ranges(batch.select(range_of(key, width).alias(RANGE)))
    if not touched:
        return 0
    state = _read(like, path).where(F.col(RANGE).isin(sorted(touched))).drop(RANGE)
    # Written aside first: the ranges that are read are the ones to be replaced.
    after = materialize(change(state, batch).select(*like.columns), "ranges")
    filled = _ranges(after.select(range_of(key, width).alias(RANGE)))
    if filled - touched:
        raise ValueError(f"the change puts rows into ranges its batch does not name: {sorted(filled - touched)[:5]}")
    _write(after, path, key, width, "overwrite")
    for emptied in sorted(touched - filled):
        _delete(spark, f"{path}/{RANGE}={emptied}")
    return len(touched)
