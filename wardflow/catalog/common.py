"""Shared by the query modules: registration and plain output types."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.sources.roles import Roles


def plain(df: DataFrame) -> DataFrame:
    """Amounts as DOUBLE, whole numbers as BIGINT, dates and times as text.

    SQL engines print decimals and dates differently; these types they share.
    """
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


class Registry:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
            self.queries[name] = lambda spark, folder: plain(build(Roles(spark, folder)))
            if sql:
                self.sql[name] = sql
            return build

        return register


def or_minus_one(*names: str) -> dict:
    """Replace missing whole numbers by -1."""
    return {name: F.coalesce(F.col(name).cast("bigint"), F.lit(-1).cast("bigint")) for name in names}


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def clock(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def amount(cents: str) -> str:
    """Cents as an amount."""
    return f"CAST(CAST(({cents}) AS DECIMAL(20,0)) / 100 AS DOUBLE)"


def amount_text(cents: str) -> str:
    """Cents printed with two decimals."""
    return f"(({cents}) // 100 || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


def struct_type(fields: dict[str, str]) -> str:
    return "STRUCT(" + ", ".join(f"{name} {kind}" for name, kind in fields.items()) + ")"


def replay_sql(
    state: str,
    row: dict[str, str],
    asked: str,
    request: dict[str, str],
    facts: dict[str, str],
    refused: str,
    changed: dict[str, str],
    done: dict[str, str],
    keeps_ended: dict[str, str] | None = None,
) -> str:
    """SQL that serves requests one after the other on a table of rows with an ``id``.

    A list of requests is folded; what is carried is the table as a list. In the expressions ``q`` is the
    request (with request_id, action and id), ``me`` its row, ``st`` the table; ``facts`` are worked out first
    and named ``f.…``. ``refused``: the message, or NULL. ``changed``: fields of a row added or updated,
    ``keeps_ended``: of a deleted one that stays. ``done``: the message for each action.
    Defines ``outcomes`` (request_id, id, accepted, message) and ``final``.
    """
    kind, ask = struct_type(row), struct_type({"request_id": "BIGINT", "action": "VARCHAR", **request})
    out = struct_type({"request_id": "BIGINT", "id": "BIGINT", "accepted": "BOOLEAN", "message": "VARCHAR"})
    def at(text: str, me: str = "f.me") -> str:
        return re.sub(r"\bq\.", "b.r.", re.sub(r"\bst\b", "a.st", re.sub(r"\bme\b", me, text)))

    found = "list_filter(a.st, lambda x: x.id = b.r.id)[1]"
    known = ", ".join(f"'{name}': {at(text, 'm')}" for name, text in facts.items())
    new = ", ".join(f"'{c}': {at(changed[c]) if c in changed else 'f.me.' + c}" for c in row if c != "id")
    ended = ", ".join(f"'{c}': {at(keeps_ended[c]) if c in keeps_ended else 'f.me.' + c}" for c in row if c != "id") if keeps_ended else ""
    rest = "list_filter(a.st, lambda x: x.id <> b.r.id)"
    gone = f"list_append({rest}, {{'id': b.r.id, {ended}}}::{kind})" if keeps_ended else rest
    told = "CASE b.r.action " + " ".join(f"WHEN '{a}' THEN '{text}'" for a, text in done.items()) + " END"
    # Requests are folded a hundred at a time, so that the list of answers is copied once for each hundred.
    inner = f"STRUCT(r {ask}, top BIGINT, st {kind}[], out {out}[])"
    outer = f"STRUCT(rs {inner}[], top BIGINT, st {kind}[], out {out}[])"
    step = f"""lambda a, b:
      list_transform([{found}], lambda m:
      list_transform([{{'me': m{", " + known if known else ""}}}], lambda f:
      list_transform([{at(refused)}], lambda why: {{
        'r': b.r,
        'top': a.top + (why IS NULL AND b.r.action = 'insert')::INT,
        'st': CASE WHEN why IS NOT NULL THEN a.st
              WHEN b.r.action = 'insert' THEN list_append(a.st, {{'id': a.top + 1, {new}}}::{kind})
              WHEN b.r.action = 'delete' THEN {gone}
              ELSE list_append({rest}, {{'id': b.r.id, {new}}}::{kind}) END,
        'out': list_append(a.out, {{'request_id': b.r.request_id,
               'id': CASE WHEN b.r.action <> 'insert' THEN b.r.id WHEN why IS NULL THEN a.top + 1 END,
               'accepted': why IS NULL, 'message': coalesce(why, {told})}}::{out})
      }})[1])[1])[1]"""
    return f"""
    begun AS ({state}),
    asked AS ({asked}),
    hundreds AS (
      SELECT block, list({{'r': {{'request_id': request_id, 'action': action, {", ".join(f"'{c}': {c}" for c in request)}}},
                          'top': NULL, 'st': NULL, 'out': NULL}}::{inner} ORDER BY request_ts, request_id) AS rs
      FROM (SELECT *, row_number() OVER (ORDER BY request_ts, request_id) // 100 AS block FROM asked) GROUP BY block),
    steps AS (SELECT list_prepend(
        {{'rs': NULL, 'top': (SELECT max(id) FROM begun), 'st': (SELECT list({{{", ".join(f"'{c}': {c}" for c in row)}}}) FROM begun), 'out': []}}::{outer},
        (SELECT list({{'rs': rs, 'top': NULL, 'st': NULL, 'out': NULL}}::{outer} ORDER BY block) FROM hundreds)) AS l),
    served AS (SELECT list_reduce(l, lambda x, y:
      list_transform([list_reduce(list_prepend({{'r': NULL, 'top': x.top, 'st': x.st, 'out': []}}::{inner}, y.rs), {step})], lambda z:
        {{'rs': NULL, 'top': z.top, 'st': z.st, 'out': list_concat(x.out, z.out)}}::{outer})[1]) AS z FROM steps),
    outcomes AS (SELECT unnest(z.out, max_depth := 2) FROM served),
    final AS (SELECT unnest(z.st, max_depth := 2) FROM served)"""
