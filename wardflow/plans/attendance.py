"""Check-in, check-out and the penalties that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.clock import at_least, at_time, minutes_between_clocks, seconds_of_day, weekday
from wardflow.functions.money import daily_pay, money, penalty_amount, penalty_label
from wardflow.functions.text import joined, same_text
from wardflow.operators.guards import JobResult, first_failure, first_per, flagged, within_batch
from wardflow.operators.snapshots import append, replace_keys, update_from


def _status(employee: DataFrame) -> DataFrame:
    return employee.select(
        "emp_id", F.lit(True).alias("known"), same_text("status", "inactive").alias("inactive")
    )


def check_in(requests: DataFrame, employee: DataFrame, attendance: DataFrame) -> JobResult:
    """One check-in per active employee and day; the earliest in the batch wins."""
    days = within_batch(attendance, "attend_date", requests, F.to_date("request_ts")).select("emp_id", "attend_date").distinct()
    state = flagged(
        requests.withColumn("attend_date", F.to_date("request_ts")).join(_status(employee), "emp_id", "left"),
        days,
        ["emp_id", "attend_date"],
        "present",
    )
    refused = first_failure(
        [
            (F.col("known").isNull(), "Employee not found in the system"),
            (F.col("inactive"), "Employee is inactive and cannot check in"),
            (F.col("present"), "Employee already checked in today"),
        ]
    )
    state = state.withColumn("refused", refused)
    winners = first_per(state.filter("refused is null"), ["emp_id", "attend_date"])
    outcomes = flagged(state, winners, ["request_id"], "won").select(
        "request_id",
        "emp_id",
        "attend_date",
        F.col("won").alias("accepted"),
        F.when(F.col("won"), "Check-in recorded successfully")
        .otherwise(F.coalesce("refused", F.lit("Employee already checked in today")))
        .alias("message"),
    )
    rows = winners.select(
        "emp_id",
        F.col("request_ts").alias("checkin"),
        F.lit(None).cast("timestamp_ntz").alias("checkout"),
        "attend_date",
    )
    return JobResult(outcomes, {"attendance": append(attendance.select(*rows.columns), rows)})


def check_out(requests: DataFrame, attendance: DataFrame) -> JobResult:
    """Close the day's open check-in; the earliest check-out in the batch wins."""
    today = within_batch(attendance, "attend_date", requests, F.to_date("request_ts"))
    days = today.join(requests.select("emp_id").distinct(), "emp_id", "left_semi").groupBy("emp_id", "attend_date").agg(
        F.count("checkout").alias("closed"), F.lit(True).alias("present")
    )
    state = requests.withColumn("attend_date", F.to_date("request_ts")).join(
        days, ["emp_id", "attend_date"], "left"
    )
    refused = first_failure(
        [
            (F.col("present").isNull(), "No check-in found for this employee today"),
            (F.col("closed") > 0, "Employee already checked out today"),
        ]
    )
    state = state.withColumn("refused", refused)
    winners = first_per(state.filter("refused is null"), ["emp_id", "attend_date"])
    outcomes = flagged(state, winners, ["request_id"], "won").select(
        "request_id",
        "emp_id",
        "attend_date",
        F.col("won").alias("accepted"),
        F.when(F.col("won"), "Checkout recorded successfully")
        .otherwise(F.coalesce("refused", F.lit("Employee already checked out today")))
        .alias("message"),
    )
    closing = winners.select("emp_id", "attend_date", F.col("request_ts").alias("checkout"))
    closed = update_from(attendance, closing, ["emp_id", "attend_date"], {"checkout": "checkout"})
    return JobResult(outcomes, {"attendance": closed, "closed_days": closing.select("emp_id", "attend_date")})


def attendance_deduction(
    keys: DataFrame, attendance: DataFrame, employee: DataFrame, weekly: DataFrame, dated: DataFrame
) -> DataFrame:
    """Message, label and amount of the penalty per (emp_id, attend_date) in ``keys``.

    Doctors are measured against their weekly slot, everybody else against the lowest
    shift of that date. Times are compared by minute boundaries.
    """
    slots = weekly.groupBy("emp_id", F.col("day").alias("weekday")).agg(
        F.min_by(F.struct("shift_start", "shift_end"), "id").alias("slot")
    )
    shifts = dated.groupBy(F.col("date").alias("attend_date")).agg(
        F.min_by(F.struct(F.col("start_time").alias("shift_start"), F.col("end_time").alias("shift_end")), "shift_id").alias(
            "shift"
        )
    )
    staff = employee.select("emp_id", "type", "salary")
    doctor = same_text("type", "doctor")
    state = (
        keys.join(attendance.select("emp_id", "attend_date", "checkin", "checkout"), ["emp_id", "attend_date"], "left")
        .join(staff, "emp_id", "left")
        .withColumn("weekday", weekday("attend_date"))
        .join(slots, ["emp_id", "weekday"], "left")
        .join(shifts, "attend_date", "left")
        .withColumn("hours", F.when(doctor, F.col("slot")).otherwise(F.col("shift")))
        .withColumn(
            "delay",
            at_least(minutes_between_clocks("hours.shift_start", seconds_of_day("checkin")), 0),
        )
        .withColumn("early", at_least(minutes_between_clocks(seconds_of_day("checkout"), "hours.shift_end"), 0))
    )
    open_message = first_failure(
        [
            (F.col("type").isNull(), "Employee not found"),
            (F.col("hours.shift_start").isNull() | F.col("hours.shift_end").isNull(), "No shift found for this date"),
            (F.col("checkin").isNull(), "No attendance record found for this date"),
            (F.col("checkout").isNull(), "Employee did not check out"),
            ((F.col("delay") == 0) & (F.col("early") == 0), "No deduction — employee was on time"),
        ]
    )
    state = state.withColumn("open_message", open_message)
    label = F.when(F.col("open_message").isNull(), penalty_label("delay", "early"))
    amount = F.when(F.col("open_message").isNull(), penalty_amount("delay", "early", "salary"))
    return state.select("emp_id", "attend_date", "open_message", label.alias("type"), amount.alias("amount")).select(
        "emp_id",
        "attend_date",
        "type",
        "amount",
        F.coalesce("open_message", joined(F.lit("Deduction applied: "), "type", F.lit(" - Amount: "), "amount")).alias(
            "message"
        ),
    )


def apply_attendance_deduction(penalties: DataFrame, deduction: DataFrame) -> DataFrame:
    """Penalties replace every deduction of that employee and day; others stay."""
    rows = penalties.filter("type is not null").select(
        "emp_id", "type", F.col("attend_date").alias("date"), "amount"
    )
    return replace_keys(deduction.select("emp_id", "type", "date", "amount"), rows, ["emp_id", "date"])


def check_out_and_deduct(
    requests: DataFrame,
    attendance: DataFrame,
    employee: DataFrame,
    weekly: DataFrame,
    dated: DataFrame,
    deduction: DataFrame,
) -> JobResult:
    """Check-outs, and with them the deductions of the days they close."""
    result = check_out(requests, attendance)
    closed, days = result.tables["closed_days"], result.tables["attendance"]
    penalties = attendance_deduction(closed, days, employee, weekly, dated)
    return JobResult(
        result.outcomes,
        {
            "attendance": days,
            "closed_days": closed,
            "penalties": penalties,
            "deduction": apply_attendance_deduction(penalties, deduction),
        },
    )


def end_offset(start: str, end: str) -> Column:
    """Seconds from a day's midnight to the end of its shift: 00:00 means 23:59, an end
    before the start the next day."""
    return (
        F.when(F.col(end) == 0, F.lit(86_340)).when(F.col(end) < F.col(start), F.col(end) + 86_400).otherwise(F.col(end))
    )


def shift_end(day: str, start: str, end: str) -> Column:
    """When a shift of that day ends."""
    return at_time(day, end_offset(start, end))


def missing_checkout(
    attendance: DataFrame,
    employee: DataFrame,
    weekly: DataFrame,
    dated: DataFrame,
    emp_shift: DataFrame,
    deduction: DataFrame,
    as_of: Column,
    grace_minutes: int = 30,
) -> JobResult:
    """Close days left open after shift end plus grace, with a full-day deduction.

    Doctors follow their weekly slot, staff the dated shift they are assigned to; a
    day without a shift is left alone. Two matching shifts give two deductions, and
    the earliest end becomes the check-out.
    """
    staff = employee.select("emp_id", "salary", same_text("type", "doctor").alias("doctor"))
    open_days = (
        attendance.filter("checkout is null")
        .select("emp_id", "attend_date")
        .join(staff, "emp_id")
        .withColumn("weekday", weekday("attend_date"))
    )
    doctor_hours = weekly.select(
        "emp_id", F.col("day").alias("weekday"), F.col("shift_start").alias("start"), F.col("shift_end").alias("end")
    )
    # The day comes with the open row, so a person meets one date of their shift, not all.
    dated_hours = dated.select(
        "shift_id",
        F.col("date").alias("attend_date"),
        F.col("start_time").alias("start"),
        F.col("end_time").alias("end"),
    )
    columns = ["emp_id", "attend_date", "salary", "start", "end"]
    timed = (
        open_days.filter("doctor").join(doctor_hours, ["emp_id", "weekday"]).select(*columns)
    ).unionByName(
        open_days.filter("not doctor")
        .join(emp_shift.select("emp_id", "shift_id"), "emp_id")
        .join(dated_hours, ["shift_id", "attend_date"])
        .select(*columns)
    )
    grace = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes))
    missed = timed.withColumn("shift_end", shift_end("attend_date", "start", "end")).filter(
        F.col("shift_end") + grace < as_of
    )
    outcomes = missed.select(
        "emp_id",
        "attend_date",
        "shift_end",
        F.lit("No checkout - Full day deduction").alias("type"),
        daily_pay("salary").alias("amount"),
    )
    closing = missed.groupBy("emp_id", "attend_date").agg(F.min("shift_end").alias("checkout"))
    rows = outcomes.select("emp_id", "type", F.col("attend_date").alias("date"), "amount")
    return JobResult(
        outcomes,
        {
            "attendance": update_from(attendance, closing, ["emp_id", "attend_date"], {"checkout": "checkout"}),
            "deduction": replace_keys(deduction.select("emp_id", "type", "date", "amount"), rows, ["emp_id", "date"]),
        },
    )


def manual_deduction(requests: DataFrame, employee: DataFrame, deduction: DataFrame, as_of: Column) -> JobResult:
    """Deductions entered by hand; the label gets a prefix, a missing date is today."""
    state = requests.join(_status(employee), "emp_id", "left")
    refused = first_failure(
        [
            (F.col("known").isNull(), "Employee not found"),
            (F.col("inactive"), "Employee is inactive and cannot add deduction"),
            (F.col("amount") <= 0, "Deduction amount must be greater than zero"),
        ]
    )
    state = state.withColumn("refused", refused)
    rows = state.filter("refused is null").select(
        "emp_id",
        joined(F.lit("Manual - "), "type").alias("type"),
        F.coalesce("date", as_of.cast("date")).alias("date"),
        money("amount", 18).alias("amount"),
    )
    outcomes = state.select(
        "request_id",
        "emp_id",
        F.col("refused").isNull().alias("accepted"),
        F.coalesce("refused", F.lit("Manual deduction added successfully")).alias("message"),
    )
    return JobResult(outcomes, {"deduction": append(deduction.select(*rows.columns), rows), "inserted": rows})


def add_reward(
    requests: DataFrame, employee: DataFrame, reward: DataFrame, as_of: Column, refuse_inactive: bool = False
) -> JobResult:
    """Rewards; an older form of the rule also refuses inactive employees."""
    rules = [(F.col("known").isNull(), "Employee not found")]
    if refuse_inactive:
        rules.append((F.col("inactive"), "Employee is inactive and cannot add reward"))
    rules.append((F.col("amount") <= 0, "Reward amount must be greater than zero"))
    state = requests.join(_status(employee), "emp_id", "left").withColumn("refused", first_failure(rules))
    rows = state.filter("refused is null").select(
        "emp_id", "type", F.coalesce("date", as_of.cast("date")).alias("date"), money("amount", 18).alias("amount")
    )
    outcomes = state.select(
        "request_id",
        "emp_id",
        F.col("refused").isNull().alias("accepted"),
        F.coalesce("refused", F.lit("Reward added successfully")).alias("message"),
    )
    return JobResult(outcomes, {"reward": append(reward.select(*rows.columns), rows), "inserted": rows})
