"""Guard chains: the first failing test decides the message of a request."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST_ORDER = ("request_ts", "request_id")


class Tables(Mapping[str, DataFrame]):
    """Tables by name; one given as a function is built when first asked for."""

    def __init__(self, entries: dict[str, DataFrame | Callable[[], DataFrame]]):
        self._entries = dict(entries)

    def __getitem__(self, name: str) -> DataFrame:
        entry = self._entries[name]
        if not isinstance(entry, DataFrame):
            entry = self._entries[name] = entry()
        return entry

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)


class JobResult:
    """Outcome per request and the next state of the tables a job changes."""

    def __init__(self, outcomes: DataFrame, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.outcomes = outcomes
        self.tables = Tables(tables or {})


def within_batch(history: DataFrame, day: str | Column, requests: DataFrame, at: Column) -> DataFrame:
    """``history`` from the first to the last day of ``requests``, as bounds the scan can use."""
    day = F.col(day) if isinstance(day, str) else day
    bounds = requests.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return history.filter(day.between(bounds.select("first").scalar(), bounds.select("last").scalar()))


def first_failure(rules: Sequence[tuple[Column, str | Column]]) -> Column:
    """Message of the first rule whose test is true; NULL when all pass."""
    chain = None
    for failed, message in rules:
        text = message if isinstance(message, Column) else F.lit(message)
        test = F.coalesce(failed, F.lit(False))
        chain = F.when(test, text) if chain is None else chain.when(test, text)
    return chain if chain is not None else F.lit(None).cast("string")


def turn() -> Column:
    """Sortable position of a request in its batch."""
    return F.struct(*REQUEST_ORDER)


def first_per(requests: DataFrame, keys: Sequence[str], *carry: str) -> DataFrame:
    """The earliest request per key; a plain aggregate, so hot keys combine early."""
    picked = requests.groupBy(*keys).agg(F.min(F.struct(*REQUEST_ORDER, *carry)).alias("_first"))
    return picked.select(*keys, "_first.*")


def flagged(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Left join on unique ``keys`` that only marks whether a partner exists."""
    return df.join(keys.select(*on).withColumn(flag, F.lit(True)), list(on), "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )
