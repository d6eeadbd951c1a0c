"""Laboratory, radiology and monthly expenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.money import money
from wardflow.functions.text import folded, joined
from wardflow.operators.catalogue import Messages, catalogue_changes
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, first_per, flagged, within_batch
from wardflow.operators.scan import highest_id, with_next_ids
from wardflow.operators.text import concat_by
from wardflow.plans.duty import department_doctor, with_receptionist
from wardflow.session import materialize

LAB_DEPARTMENT = 13
RADIOLOGY_DEPARTMENT = 14

LAB_TEXTS = Messages(
    inserted="New lab test added successfully.",
    name_exists="Test name already exists.",
    updated="Test updated successfully.",
    name_taken="Another test with this name already exists.",
    deleted="Test deleted successfully.",
    missing="No test found with the given ID.",
    id_required="test_id is required for update.",
    invalid="Invalid action. Use INSERT, UPDATE, or DELETE.",
)
RADIOLOGY_TEXTS = Messages(
    inserted="New radiology record added successfully.",
    name_exists="Radiology name already exists.",
    updated="Radiology record updated successfully.",
    name_taken="Another radiology record with this name already exists.",
    deleted="Radiology record deleted successfully.",
    missing="No radiology record found with the given ID.",
    id_required="rad_id is required for update.",
    invalid="Invalid action. Use INSERT or UPDATE only.",
)
NEGATIVE_PRICE = "Price cannot be negative."


def lab_test_changes(changes: DataFrame, lab_tests: DataFrame) -> JobResult:
    """Insert, update and delete lab tests; the price is tested on insert only."""
    return catalogue_changes(
        changes,
        lab_tests,
        "test_id",
        "test_name",
        ["test_name", "delivery_duration", "price"],
        LAB_TEXTS,
        [(F.col("price") < 0, NEGATIVE_PRICE)],
        table="lab_tests",
    )


def radiology_changes(changes: DataFrame, radiology: DataFrame) -> JobResult:
    """Insert, update and delete radiology examinations."""
    return catalogue_changes(
        changes,
        radiology,
        "rad_id",
        "rad_name",
        ["rad_name", "delivery_duration", "price"],
        RADIOLOGY_TEXTS,
        [(F.col("price") < 0, NEGATIVE_PRICE)],
        table="radiology",
    )


def _order_items(lines: DataFrame, catalogue: DataFrame, name: str, item_id: str) -> DataFrame:
    """Ordered names, one row per request and spelling, with the catalogue's id and price.

    Lines are combined before the catalogue is joined; ``n`` says how often the name
    was listed, an unknown name has no id.
    """
    items = catalogue.groupBy(folded(name).alias("_name")).agg(
        F.min(F.struct(F.col(item_id).alias("item_id"), "price")).alias("_item")
    )
    named = lines.groupBy("request_id", folded("name").alias("_name"), "name").agg(F.count("*").alias("n"))
    found = named.join(items, "_name", "left").select(
        "request_id", "name", "_name", "n", "_item.item_id", "_item.price"
    )
    return materialize(found, "items")


def _order_totals(items: DataFrame) -> DataFrame:
    """Per request: lines, known lines, their price, and whether an examination is listed twice."""
    # Both groupings work on the lines of a request, so these are brought together once.
    per_item = items.repartition("request_id").groupBy("request_id", "item_id").agg(F.sum("n").alias("n"), F.max("price").alias("price"))
    known = F.col("item_id").isNotNull()
    return per_item.groupBy("request_id").agg(
        F.sum("n").alias("line_count"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known_count"),
        F.sum(F.col("n") * F.col("price")).alias("total"),
        (F.max(F.when(known, F.col("n"))) > 1).alias("repeated"),
    )


def _booking_rows(
    made: DataFrame, items: DataFrame, names: DataFrame, kind: str, dept_id: int, item_column: str
) -> dict[str, DataFrame]:
    lines = items.join(made.select("request_id", "reservation_id", "invoice_id"), "request_id")
    return {
        "reserve": lines.select(
            F.col("item_id").alias(item_column), "reservation_id", F.lit(None).cast("string").alias("test_result")
        ),
        "invoice_details": lines.select(
            "invoice_id",
            "reservation_id",
            F.lit(kind).alias("reservation_type"),
            F.col("item_id").alias("process_id"),
            F.col("price").alias("unit_price"),
            F.lit(1).alias("quantity"),
            F.col("price").alias("total"),
            F.lit(dept_id).alias("dept_id"),
        ),
        "reservation_names": names,
    }


def book_lab(
    requests: DataFrame,
    lines: DataFrame,
    lab_tests: DataFrame,
    employee: DataFrame,
    weekly: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    lab_reservation: DataFrame,
    invoice: DataFrame,
) -> JobResult:
    """Book several lab tests at once.

    All tests must exist and the amount paid, if given, must be their sum. The doctor
    and the receptionist may stay empty. An order without lines, or with one test
    listed twice, is refused.
    """
    items = _order_items(lines, lab_tests, "test_name", "test_id")
    asked = requests.join(_order_totals(items), "request_id", "left")
    asked = asked.withColumn("total", money("total")).withColumn(
        "refused",
        first_failure(
            [
                (F.col("known_count") < F.col("line_count"), "One or more tests do not exist."),
                (F.col("line_count").isNull(), "The order has no tests."),
                (F.col("repeated"), "A test is listed more than once."),
                (
                    F.col("paid_money") != F.col("total"),
                    joined(F.lit("Incorrect paid amount. Total required = "), "total"),
                ),
            ]
        ),
    )
    asked = department_doctor(asked, employee, weekly, LAB_DEPARTMENT, "lab_doctor_id")
    asked = with_receptionist(asked, employee, emp_shift, dated, today_only=False)
    asked = materialize(asked, "asked")
    made = with_next_ids(asked.filter("refused is null"), lab_reservation, "reservation_id", REQUEST_ORDER)
    made = made.withColumn(
        "invoice_id",
        F.col("reservation_id") - highest_id(lab_reservation, "reservation_id") + highest_id(invoice, "invoice_id"),
    )
    chosen = items.join(made.select("request_id"), "request_id", "left_semi")
    names = concat_by(chosen, ["request_id"], F.col("name"), " , ", ["name"], "names")
    reservations = made.join(names, "request_id").select(
        "reservation_id",
        F.to_date("request_ts").alias("date"),
        F.col("total").alias("paid_money"),
        "p_id",
        F.col("lab_doctor_id").alias("doctor_id"),
        F.col("names").alias("test_name"),
        F.col("receptionist_id").cast("string").alias("receptionist_id"),
    )
    outcomes = asked.join(
        made.select("request_id", "reservation_id", "invoice_id"), "request_id", "left"
    ).select(
        "request_id",
        F.col("reservation_id").isNotNull().alias("accepted"),
        F.coalesce(
            "refused", joined(F.lit("Lab reservation added successfully. Reservation ID = "), "reservation_id")
        ).alias("message"),
        "reservation_id",
        "invoice_id",
    )
    tables = _booking_rows(made, chosen, names, "lab", LAB_DEPARTMENT, "test_id")
    tables["lab_reservation"] = reservations
    tables["invoice"] = made.select(
        "invoice_id",
        F.to_date("request_ts").alias("date"),
        "payment_method",
        F.col("total").alias("paid_money"),
        "p_id",
        F.col("lab_doctor_id").alias("emp_id"),
    )
    return JobResult(outcomes, tables)


def book_radiology(
    requests: DataFrame,
    lines: DataFrame,
    radiology: DataFrame,
    patient: DataFrame,
    employee: DataFrame,
    weekly: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    radio_reservation: DataFrame,
    invoice: DataFrame,
    compat: bool = True,
) -> JobResult:
    """Book several radiology examinations at once.

    In the compatible form the test for a repeat on the same day compares one name
    with the stored list of names, so only single-examination bookings are ever
    recognised; otherwise the stored list is split. Bookings accepted earlier in the
    batch count as stored.
    """
    items = _order_items(lines, radiology, "rad_name", "rad_id")
    asked = requests.join(_order_totals(items), "request_id", "left")
    asked = flagged(asked, patient.select("p_id").distinct(), ["p_id"], "patient_known")
    asked = department_doctor(asked, employee, weekly, RADIOLOGY_DEPARTMENT, "radio_doctor_id")
    asked = with_receptionist(asked, employee, emp_shift, dated, today_only=False, wrap=True)
    today = within_batch(radio_reservation, F.to_date("date"), requests, F.to_date("request_ts"))
    stored = today.select("p_id", F.to_date("date").alias("day"), F.col("rad_name").alias("stored"))
    if not compat:
        stored = stored.withColumn("stored", F.explode(F.split("stored", ", ")))
    stored = stored.select("p_id", "day", folded("stored").alias("_name")).distinct()
    wanted = items.select("request_id", "_name").join(
        requests.select("request_id", "request_ts", "p_id", F.to_date("request_ts").alias("day")), "request_id"
    )
    repeat_text = "Patient already booked one or more of these tests today."
    repeats = wanted.join(stored, ["p_id", "day", "_name"], "left_semi").select("request_id").distinct()
    asked = flagged(asked, repeats, ["request_id"], "booked_before").withColumn(
        "refused",
        first_failure(
            [
                (~F.col("patient_known"), "Invalid patient ID."),
                (F.col("radio_doctor_id").isNull(), "No radiology doctor available today."),
                (F.col("receptionist_id").isNull(), "No receptionist available in the current shift."),
                (F.col("known_count") < F.col("line_count"), "One or more radiology names are invalid."),
                (F.col("line_count").isNull(), "The order has no examinations."),
                (F.col("booked_before"), repeat_text),
                (F.col("repeated"), "An examination is listed more than once."),
            ]
        ),
    )
    asked = materialize(asked, "asked")
    free = asked.filter("refused is null").select(*REQUEST_ORDER, "p_id", F.to_date("request_ts").alias("day"), "line_count")
    candidates = items.select("request_id", "_name").join(free, "request_id")
    if compat:
        # A booking can only block others if it is a single examination. The first
        # single booking per patient, day and name is accepted unless it is itself
        # blocked, and nothing earlier can block it; every later request is blocked.
        blockers = first_per(candidates.filter("line_count = 1"), ["p_id", "day", "_name"])
        blocked = (
            candidates.join(
                blockers.select("p_id", "day", "_name", F.struct(*REQUEST_ORDER).alias("_by")), ["p_id", "day", "_name"]
            )
            .filter(F.struct(*REQUEST_ORDER) > F.col("_by"))
            .select("request_id")
            .distinct()
        )
    else:
        blocked = _blocked_by_any(candidates)
    # Numbers and answers both ask who is blocked.
    blocked = materialize(blocked, "blocked")
    asked = flagged(asked, blocked, ["request_id"], "blocked").withColumn(
        "refused", F.coalesce("refused", F.when(F.col("blocked"), repeat_text))
    )
    made = with_next_ids(asked.filter("refused is null"), radio_reservation, "reservation_id", REQUEST_ORDER)
    made = made.withColumn(
        "invoice_id",
        F.col("reservation_id") - highest_id(radio_reservation, "reservation_id") + highest_id(invoice, "invoice_id"),
    ).withColumn("total", money("total"))
    chosen = items.join(made.select("request_id"), "request_id", "left_semi")
    names = concat_by(chosen, ["request_id"], F.col("name"), ", ", ["name"], "names")
    reservations = made.join(names, "request_id").select(
        "reservation_id",
        F.to_date("request_ts").alias("date"),
        F.col("total").alias("paid_money"),
        "p_id",
        F.col("names").alias("rad_name"),
        F.col("radio_doctor_id").alias("doctor_id"),
        F.col("receptionist_id").cast("string").alias("receptionist_id"),
    )
    outcomes = asked.join(
        made.select("request_id", "reservation_id", "invoice_id", F.col("total").alias("billed")), "request_id", "left"
    ).select(
        "request_id",
        F.col("reservation_id").isNotNull().alias("accepted"),
        F.coalesce(
            "refused",
            joined(
                F.lit("Radiology reservation completed. Total = "),
                "billed",
                F.lit(" | Reservation ID = "),
                "reservation_id",
                F.lit(" | Invoice = "),
                "invoice_id",
            ),
        ).alias("message"),
        "reservation_id",
        "invoice_id",
    )
    tables = _booking_rows(made, chosen, names, "Radiology", RADIOLOGY_DEPARTMENT, "rad_id")
    tables["radio_reservation"] = reservations
    tables["invoice"] = made.select(
        "invoice_id",
        F.to_date("request_ts").alias("date"),
        "payment_method",
        F.col("total").alias("paid_money"),
        "p_id",
        F.col("receptionist_id").alias("emp_id"),
    )
    return JobResult(outcomes, tables)


def _blocked_by_any(candidates: DataFrame) -> DataFrame:
    """Requests refused because an accepted earlier request of that patient and day
    holds one of their names; settled in rounds like other uniqueness rules."""
    keys = ["p_id", "day", "_name"]
    waiting = candidates.select(*REQUEST_ORDER, *keys).distinct()
    blocked = None
    while True:
        first = waiting.groupBy(*keys).agg(F.min(F.struct(*REQUEST_ORDER)).alias("_first"))
        late = (
            waiting.join(first, keys)
            .withColumn("_late", F.col("_first") < F.struct(*REQUEST_ORDER))
            .groupBy("request_id")
            .agg(F.max("_late").alias("_late"))
        )
        winners = waiting.join(late.filter("not _late").select("request_id"), "request_id", "left_semi")
        held = materialize(winners.select("request_id", *keys), "held")
        rest = waiting.join(held.select("request_id").distinct(), "request_id", "left_anti")
        losers = rest.join(held.select(*keys), keys, "left_semi").select("request_id").distinct()
        losers = materialize(losers, "losers")
        blocked = losers if blocked is None else blocked.unionByName(losers)
        waiting = materialize(rest.join(losers, "request_id", "left_anti"), "waiting")
        if waiting.isEmpty():
            return blocked


def post_results(results: DataFrame, reserve: DataFrame, catalogue: DataFrame, item_id: str, name: str) -> DataFrame:
    """Write results into reservation lines, matched by (reservation, examination name).

    When a batch holds several results for one line the last one counts.
    """
    names = catalogue.select(item_id, folded(name).alias("_name"))
    latest = results.groupBy("reservation_id", folded("name").alias("_name")).agg(
        F.max_by("test_result", F.struct(*REQUEST_ORDER)).alias("_result"), F.lit(True).alias("_posted")
    )
    return (
        reserve.join(names, item_id, "left")
        .join(latest, ["reservation_id", "_name"], "left")
        .withColumn("test_result", F.when(F.col("_posted"), F.col("_result")).otherwise(F.col("test_result")))
        .select(*reserve.columns)
    )


def add_expenses(requests: DataFrame, types: DataFrame, expenses: DataFrame, scope: tuple[str, ...] = ()) -> JobResult:
    """One expense per type and calendar month; the earliest request wins.

    ``scope`` names further columns (a branch, say) within which the rule holds.
    """
    known = types.select(folded("expense_type").alias("_type"), "expense_id")
    month = F.trunc("date", "MM")
    keys = ["expense_id", "month", *scope]
    done = expenses.select("expense_id", month.alias("month"), *scope).distinct()
    asked = requests.withColumns({"_type": folded("expense_type"), "month": month}).join(known, "_type", "left")
    asked = flagged(asked, done, keys, "exists").withColumn(
        "refused",
        first_failure(
            [
                (F.col("expense_id").isNull(), "Invalid expense type."),
                (F.col("exists"), "Expense for this type already exists this month."),
            ]
        ),
    )
    firsts = first_per(asked.filter("refused is null"), keys)
    outcomes = flagged(asked, firsts, ["request_id"], "won").select(
        "request_id",
        F.col("won").alias("accepted"),
        F.when(F.col("won"), "Expense added successfully.")
        .otherwise(F.coalesce("refused", F.lit("Expense for this type already exists this month.")))
        .alias("message"),
    )
    rows = asked.join(firsts.select("request_id"), "request_id", "left_semi").select(
        "date", "expense_id", money("amount").alias("amount"), *scope
    )
    return JobResult(outcomes, {"expenses": rows})
