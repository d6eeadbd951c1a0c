"""Batches of INSERT, UPDATE and DELETE on master tables with a unique name, in request order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.text import folded
from wardflow.operators.guards import JobResult, first_failure
from wardflow.operators.replay import Answer, Book, Rules, replay


@dataclass(frozen=True)
class Messages:
    """Texts a catalogue answers with; NULL entries switch a test off."""

    inserted: str
    name_exists: str
    updated: str
    name_taken: str
    deleted: str
    missing: str
    missing_first: bool = False
    id_required: str | None = None
    in_use: str | None = None
    invalid: str | None = None


def _rules(key: str, columns: list[str], sets: Sequence[str], texts: Messages) -> Rules:
    def insert(request: dict, book: Book) -> Answer:
        if book.held("_name", request["_name"]):
            return False, texts.name_exists, None
        if request["_refused"]:
            return False, request["_refused"], None
        new = {c: request.get(c) for c in columns} | {"_name": request["_name"]}
        return True, texts.inserted, book.insert(new)

    def update(request: dict, book: Book) -> Answer:
        at, row = request[key], book.row(request[key])
        if texts.id_required and at is None:
            return False, texts.id_required, at
        held = at is not None and book.held("_name", request["_name"], but=row)
        if row is None and (texts.missing_first or not held):
            return False, texts.missing, at
        if held:
            return False, texts.name_taken, at
        # NULL fields keep what is stored.
        book.update(row, {c: request[c] for c in (*sets, "_name") if request[c] is not None})
        return True, texts.updated, at

    def delete(request: dict, book: Book) -> Answer:
        at, row = request[key], book.row(request[key])
        if row is None:
            return False, texts.missing, at
        if request["_used"]:
            return False, texts.in_use, at
        book.delete(row)
        return True, texts.deleted, at

    def answer(request: dict, book: Book) -> Answer:
        act = {"insert": insert, "update": update, "delete": delete}.get(request["_action"])
        if act:
            return act(request, book)
        return (False, texts.invalid, request[key]) if texts.invalid else None

    return answer


def catalogue_changes(
    changes: DataFrame,
    state: DataFrame,
    key: str,
    name: str,
    sets: Sequence[str],
    texts: Messages,
    insert_rules: Sequence[tuple[Column, str]] = (),
    used: DataFrame | None = None,
    table: str = "catalogue",
) -> JobResult:
    """Apply a mixed batch as a loop would; ``changes.action`` is compared without regard to case."""
    asked = changes.withColumns(
        {"_action": folded("action"), "_name": folded(name), "_refused": first_failure(list(insert_rules)), "_used": F.lit(False)}
    )
    if used is not None:
        held = used.select(key).distinct().withColumn("_used", F.lit(True))
        asked = asked.drop("_used").join(held, key, "left")
    rules = _rules(key, state.columns, sets, texts)
    outcomes, rows = replay(asked, state.withColumn("_name", folded(name)), key, ["_name"], rules)
    return JobResult(outcomes, {table: rows})
