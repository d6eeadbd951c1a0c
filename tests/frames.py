"""Small helpers to build test tables and read results."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from wardflow.schemas import table_schema

D = dt.date
TS = dt.datetime


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def table(spark, name, rows):
    """Rows given as dicts in the layout of a hospital table; missing columns are NULL."""
    schema = table_schema(name)
    import copy

    loose = copy.deepcopy(schema)
    for f in loose.fields:
        f.nullable = True
    return spark.createDataFrame([tuple(r.get(f.name) for f in loose.fields) for r in rows], loose)


def messages(result):
    return {r["request_id"]: r["message"] for r in result.outcomes.collect()}


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


@contextmanager
def many_ranges(spark):
    """Keep small shuffles apart, so that results cross range borders."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
