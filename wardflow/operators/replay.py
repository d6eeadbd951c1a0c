"""Requests that add, change and delete rows of one table, answered as a loop over them would.

What a request may do depends on the requests before it: whether its row is there, and whether other rows
hold a value it wants for itself. Both are changes of state that compose. Of a range of requests all one
has to know is how it leaves each row it touched, and how many rows it added; who holds which value follows
from the rows. So requests are cut, in their order, into ranges of bounded size; a task replays a range,
starting from the rows and numbers of holders its requests ask for, and summarises it. A window of ranges,
a few times as many as there are cores, is replayed at once, first from what the ranges before the window leave, then
again with what the ranges before each are now known to leave: summaries are chained with windows over (row,
range) and (value, range). Ranges up to the first whose summary changed have their final answers and are not
replayed again. A summary tells the columns a range wrote from those it passes on, and a row once deleted stays
so, whatever ranges replayed too early made of it. Then most ranges tell the same wherever they began, and a
few rounds settle a window.
Every round settles one range at least, so rounds, each no longer than a range, grow with the batch and not
with its square, even if every range depends on the one before it; a window that a few rounds do not settle is
cut to a range a core, and the next ones are smaller until few rounds settle them again. A batch of at most ``RANGE_REQUESTS`` requests takes one round.

A hot row or value spreads over ranges like any other; no task holds more than a range and the rows and
values its requests name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from wardflow.operators.guards import REQUEST_ORDER
from wardflow.operators.scan import highest_id, number_rows
from wardflow.session import materialize, scratch_path

# Requests a task replays at once.
RANGE_REQUESTS = 200_000

# Ranges replayed at once, at most; None: WAVES times as many as Spark has cores where few rounds settle them, else as many as cores.
RANGES_AT_ONCE: int | None = None
WAVES = 4

# A window that takes more rounds, and more than half as many as it has ranges, is followed by a smaller one.
FEW_ROUNDS = 4

# Results of so many rounds are read from where the rounds wrote them; beyond, they are put together.
ROUNDS_APART = 40


class Book:
    """A range's view of the table: rows by key, and how many rows hold a value."""

    def __init__(self, key: str, claims: Sequence[str], rows: dict, holders: dict, next_id: int):
        self.key, self.claims = key, claims
        self.rows, self.next_id, self.added = rows, next_id, 0
        self.holders = dict(holders)
        # Columns written, by row touched.
        self.written: dict = {}

    def row(self, key) -> dict | None:
        return self.rows.get(key)

    def held(self, claim: str, value, but: dict | None = None) -> bool:
        """Whether a row other than ``but`` holds ``value``; NULL is never held."""
        if value is None:
            return False
        return self.holders.get((claim, value), 0) > (but is not None and but[claim] == value)

    def _count(self, row: dict, n: int) -> None:
        for claim in self.claims:
            if row[claim] is not None:
                self.holders[claim, row[claim]] = self.holders.get((claim, row[claim]), 0) + n

    def insert(self, row: dict):
        """Add a row under the next id, which is returned."""
        row[self.key] = self.next_id
        self.next_id += 1
        self.added += 1
        self.rows[row[self.key]] = row
        self.written[row[self.key]] = set(row)
        self._count(row, 1)
        return row[self.key]

    def update(self, row: dict, values: dict) -> None:
        self._count(row, -1)
        row.update(values)
        self._count(row, 1)
        self.written.setdefault(row[self.key], set()).update(values)

    def delete(self, row: dict) -> None:
        self._count(row, -1)
        del self.rows[row[self.key]]
        self.written.setdefault(row[self.key], set())


# (accepted, message, key the answer names); None for a request without an answer.
Answer = tuple[bool, str, int | None] | None
Rules = Callable[[dict, Book], Answer]


def _values(column: pa.ChunkedArray) -> list:
    """Python values; by way of objects, as Arrow makes them one by one."""
    kind = column.type
    if any(test(kind) for test in (pa.types.is_integer, pa.types.is_boolean, pa.types.is_string, pa.types.is_decimal, pa.types.is_date32)):
        return column.to_pandas(integer_object_nulls=True).tolist()
    return column.to_pylist()


def _dicts(table: pa.Table) -> Iterator[dict]:
    names = table.column_names
    for entry in zip(*map(_values, table.columns)):
        yield dict(zip(names, entry))


def _replayer(key: str, claims: Sequence[str], columns: list[str], asks: list[str], rules: Rules, schema: pa.Schema) -> Callable:
    """Replays the range that a task is given: its requests, and what is known when it begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        given = pa.Table.from_batches(batches) if batches else None
        is_request = pc.equal(given["_kind"], "request") if batches else None
        if not (batches and pc.any(is_request).as_py()):
            return
        rows, holders, base = {}, {}, 0
        for entry in _dicts(given.filter(pc.invert(is_request)).select(["_kind", *columns, *claims, "_claim", "_value", "_n"])):
            if entry["_kind"] == "row":
                rows[entry[key]] = {c: entry[c] for c in (*columns, *claims)}
            elif entry["_kind"] == "count":
                holders[entry["_claim"], entry["_value"]] = entry["_n"]
            else:
                base = entry["_n"]
        book = Book(key, claims, rows, holders, base + 1)
        answers = []
        requests = given.filter(is_request).sort_by("_place")
        number = requests["_range"][0].as_py()
        for request in _dicts(requests.select(asks)):
            answer = rules(request, book)
            if answer is not None:
                answers.append((request["request_id"], *answer))
        out = []
        for touched in sorted(book.written):
            row = book.rows.get(touched)
            told = sorted(book.written[touched]) if row else []
            out.append({"_kind": "row", **(row or {}), key: touched, "accepted": row is not None, "_written": told})
        if book.added:
            out.append({"_kind": "base", "_n": book.added})
        names = schema.names
        left = pa.Table.from_pylist([{**dict.fromkeys(names), **entry, "_range": number} for entry in out], schema)
        told = dict(zip(("request_id", "accepted", "message", "_n"), zip(*answers))) if answers else {}
        fixed = {"_kind": "answer", "_range": number}
        filled = [told.get(name) or [fixed.get(name)] * len(answers) for name in names]
        yield from left.to_batches()
        yield from pa.table([pa.array(v, f.type) for v, f in zip(filled, schema)], schema).to_batches()

    return run


def _materialize_all(*tables: tuple) -> list[DataFrame]:
    """Tables that do not depend on each other, written at the same time."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda table: materialize(*table), tables))


def replay(
    requests: DataFrame, state: DataFrame, key: str, claims: Sequence[str], rules: Rules, range_requests: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Outcomes (request_id, accepted, message, ``key``) and the next state.

    ``state`` has the columns of the table and the text columns ``claims``, whose values rows hold;
    ``requests`` have, under the same names, the values they may ask about, and what ``rules`` needs. New
    rows get the ids after the highest in use when the batch begins.
    """
    spark = state.sparkSession
    size = range_requests or RANGE_REQUESTS
    columns = [c for c in state.columns if c not in claims]
    typed = requests.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in state.schema if f.name in requests.columns})
    placed = number_rows(typed, REQUEST_ORDER, "_place")
    asks = [c for c in typed.columns if c != "request_ts" or c in columns]
    # One folder a range, so that a round reads its ranges only.
    asked = materialize(placed.withColumn("_range", F.floor((F.col("_place") - 1) / size).cast("long")), "asked", "_range")
    n_ranges = (asked.agg(F.max("_range")).first()[0] or 0) + 1
    at_once = RANGES_AT_ONCE or max(2, spark.sparkContext.defaultParallelism)
    most = RANGES_AT_ONCE or WAVES * at_once

    def value_rows(df: DataFrame, *carry: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("_claim"), F.col(c).alias("_value")) for c in claims]))
        return df.select(*carry, each.alias("_each")).select(*carry, "_each.*").where("_value IS NOT NULL")

    value = ["_claim", "_value"]
    wanted_rows = asked.where(F.col(key).isNotNull()).select("_range", key).distinct()
    wanted_values = value_rows(asked, "_range").distinct()
    if n_ranges > 1:
        wanted_rows, wanted_values = _materialize_all((wanted_rows, "wanted", "_range"), (wanted_values, "wanted", "_range"))
    # Up to which range a row or value is asked for.
    row_until = wanted_rows.groupBy(key).agg(F.max("_range").alias("_until"))
    value_until = wanted_values.groupBy(*value).agg(F.max("_range").alias("_until"))
    first_counts = value_rows(state).groupBy(*value).agg(F.count("*").alias("_n"))
    rows, counts = state.join(row_until, key, "left_semi"), first_counts.join(value_until, value, "left_semi")
    top = highest_id(state, key)
    if n_ranges > 1:
        rows, counts, row_until, value_until = _materialize_all(
            (rows, "first_rows"), (counts, "first_counts"), (row_until, "until"), (value_until, "until")
        )
        top = F.lit(spark.range(1).select(top).first()[0])

    fields = [*columns, *claims]
    others = [c for c in fields if c != key]
    kinds = "_range long, _kind string, request_id long, accepted boolean, message string, _claim string, _value string, _n long, _written array<string>"
    schema = T._parse_datatype_string(kinds)
    schema = T.StructType([*schema.fields, *(T.StructField(f.name, f.dataType) for f in state.select(*fields).schema)])
    run = _replayer(key, list(claims), columns, asks, rules, to_arrow_schema(schema))

    def replayed(first: int, last: int, summary: DataFrame | None, added: dict[int, int]) -> DataFrame:
        """Ranges ``first`` to ``last``, given the summaries of ranges the rows and counts do not hold yet."""
        here = F.col("_range").between(first, last)
        asked_rows, asked_values = wanted_rows.where(here), wanted_values.where(here)
        if summary is None:
            known_rows, known_counts = asked_rows.join(rows, key), asked_values.join(counts, value)
        else:
            chained = _chained(asked_rows, rows, summary.where("_kind = 'row'"), key, fields)
            known_rows = chained.where("accepted IS NULL AND _there").select("_range", key, *[F.col(f"_before.{c}.{c}") for c in others])
            known_counts = _sum_before(asked_values, counts, _moved(chained, claims), value)
        before = [(r, sum(n for a, n in added.items() if a < r)) for r in range(first, last + 1)]
        bases = spark.createDataFrame(before, "_range long, _n long").withColumn("_n", F.col("_n") + top)
        whole = asked.where(here).select("_range", "_place", *asks).withColumn("_kind", F.lit("request"))
        for part, kind in ((known_rows, "row"), (known_counts, "count"), (bases, "base")):
            whole = whole.unionByName(part.withColumn("_kind", F.lit(kind)), allowMissingColumns=True)
        # A range is a task.
        placed = whole.repartitionById(last - first + 1, (F.col("_range") - first).cast("int"))
        return materialize(placed.mapInArrow(run, schema), "replayed")

    path, written, apart = scratch_path(spark, "settled"), False, []
    width, begin, guess = most, 0, 0
    while begin < n_ranges:
        last = min(begin + width, n_ranges) - 1
        first, summary, settled, rounds = begin, None, None, 0
        # Before they are replayed, ranges are taken to leave the rows as they are and to add as many as the range before them.
        added = dict.fromkeys(range(begin, last + 1), guess)
        marks = dict.fromkeys(added, (0, None, guess) if guess else None)
        while first <= last:
            done, upto = replayed(first, last, summary, added), last
            rounds += 1
            if n_ranges > 1:
                wrote = [F.when(F.array_contains("_written", c), F.col(c)) for c in others]
                digest = F.sum(F.xxhash64(key, "accepted", "_written", *wrote).cast("decimal(38,0)")).alias("_digest")
                new = F.sum(F.when(F.col("_kind") == "base", F.col("_n"))).alias("_new")
                told = done.where("_kind <> 'answer'").groupBy("_range").agg(F.count("*").alias("_size"), digest, new).collect()
                before, marks = marks, {row["_range"]: tuple(row)[1:] for row in told}
                added |= {r: (marks[r][2] or 0) if r in marks else 0 for r in range(first, last + 1)}
                # A range is right if the ranges before it did what it was told they do.
                upto = next((r for r in range(first, last) if marks.get(r) != before.get(r)), last)
            right = done.where(F.col("_range") <= upto)
            settled = right if settled is None else settled.unionByName(right)
            apart.append(right)
            summary = settled.unionByName(done.where(F.col("_range") > upto)).where("_kind <> 'answer'")
            first = upto + 1
            if rounds >= FEW_ROUNDS:
                # Ranges depend on those before them: replaying more than the cores take at once is in vain.
                last = min(last, max(upto, first + at_once - 1))
                added = {r: n for r, n in added.items() if r <= last}
        if n_ranges == 1:
            break
        if len(apart) > ROUNDS_APART:
            reduce(DataFrame.unionByName, apart).write.mode("append").parquet(path)
            written, apart = True, []
        if last < n_ranges - 1:
            left = settled.where("_kind <> 'answer'")
            changed = _last_rows(left, key, fields).join(row_until.where(F.col("_until") > last), key, "left_semi")
            kept = rows.join(left.where("_kind = 'row'").select(key).distinct(), key, "left_anti")
            moved = _moved(_chained(None, rows, left.where("_kind = 'row'"), key, fields), claims)
            grown = counts.select(*value, "_n").unionByName(moved.select(*value, "_n"))
            grown = grown.join(value_until.where(F.col("_until") > last), value, "left_semi")
            rows, counts = _materialize_all(
                (kept.select(*fields).unionByName(changed.where("accepted").select(*fields)), "rows"),
                (grown.groupBy(*value).agg(F.sum("_n").alias("_n")), "counts"),
            )
            top = F.lit(spark.range(1).select(top).first()[0] + sum(added.values()))
        guess = added[last]
        few = rounds <= max(FEW_ROUNDS, min(at_once, last - begin + 1) // 2)
        begin, width = last + 1, min(most, 2 * width) if few else max(1, min(width, at_once) // 2)

    if n_ranges > 1:
        settled = reduce(DataFrame.unionByName, [*([spark.read.schema(schema).parquet(path)] if written else []), *apart])
    outcomes = settled.where("_kind = 'answer'").select("request_id", "accepted", "message", F.col("_n").alias(key))
    final = _last_rows(settled, key, columns)
    kept = state.select(*columns).join(final.select(key), key, "left_anti")
    return outcomes, kept.select(*columns).unionByName(final.where("accepted").select(*columns))


def _last_rows(summary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows touched, as the last range left them; those deleted are not ``accepted``."""
    row = F.struct("accepted", *[c for c in fields if c != key])
    last = summary.where("_kind = 'row'").groupBy(key).agg(F.max_by(row, "_range").alias("_last"))
    return last.select(key, "_last.*")


def _chained(wanted: DataFrame | None, first: DataFrame, summary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows ``wanted`` (``accepted`` is NULL) and those touched, each with how the ranges before left it.

    ``_there`` says whether it was there (NULL: not heard of), ``_before`` holds its columns as last written.
    Rows touched after they were deleted, by ranges replayed too early, are left out.
    """
    others = [c for c in fields if c != key]
    begun = first.select(
        F.lit(-1).cast("long").alias("_range"), key, F.lit(True).alias("accepted"), F.array(*map(F.lit, others)).alias("_written"), *others
    )
    told = begun.unionByName(summary.select("_range", key, "accepted", "_written", *others))
    if wanted is not None:
        told = told.unionByName(wanted.select("_range", key), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_range", F.col("accepted").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.array_contains("_written", c), F.struct(c)), ignorenulls=True).over(order).alias(c) for c in others]
    told = told.withColumns({"_there": F.min("accepted").over(order), "_before": F.struct(*last)})
    return told.where("_range >= 0 AND coalesce(_there, true)")


def _moved(chained: DataFrame, claims: Sequence[str]) -> DataFrame:
    """By how much each range changes the number of rows that hold a value."""
    each = []
    for c in claims:
        was = F.when(F.col("_there"), F.col(f"_before.{c}.{c}"))
        now = F.when(F.col("accepted"), F.when(F.array_contains("_written", c), F.col(c)).otherwise(was))
        each += [F.struct(F.lit(c).alias("_claim"), held.alias("_value"), F.lit(n).cast("long").alias("_n")) for held, n in ((was, -1), (now, 1))]
    moves = chained.where("accepted IS NOT NULL").select("_range", F.explode(F.array(*each)).alias("_each")).select("_range", "_each.*")
    moves = moves.where("_value IS NOT NULL").groupBy("_range", "_claim", "_value").agg(F.sum("_n").alias("_n"))
    return moves.where("_n <> 0")


def _sum_before(wanted: DataFrame, first: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers asked for: the first ones and all changes by ranges before."""
    probe = F.lit(None).cast("long")
    begun = first.select(F.lit(-1).cast("long").alias("_range"), *keys, "_n")
    left, probes = summary.select("_range", *keys, "_n"), wanted.select("_range", *keys, probe.alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_range", F.col("_n").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    told = begun.unionByName(left).unionByName(probes).withColumn("_sum", F.sum("_n").over(order))
    return told.where("_n IS NULL").select("_range", *keys, F.coalesce("_sum", F.lit(0)).cast("long").alias("_n"))
