"""Who is on duty at a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.clock import seconds_of_day, weekday
from wardflow.functions.text import same_text
from wardflow.operators.intervals import lowest_on_duty, on_duty


def with_doctor(
    requests: DataFrame, weekly: DataFrame, price: str = "examination_price", wrap: bool = False
) -> DataFrame:
    """Add ``duty_doctor`` (emp_id, price): lowest doctor of the department on duty at ``request_ts``."""
    slots = weekly.withColumnRenamed("day", "_weekday")
    asked = requests.withColumns({"_weekday": weekday("request_ts"), "_clock": seconds_of_day("request_ts")})
    keys, pick = ["dept_id", "_weekday"], ["emp_id", price]
    found = lowest_on_duty(asked, slots, keys, "_clock", "shift_start", "shift_end", pick, "duty_doctor", wrap)
    return found.drop("_weekday", "_clock")


def receptionist_slots(employee: DataFrame, emp_shift: DataFrame, dated: DataFrame) -> DataFrame:
    """Dated shifts with the lowest receptionist assigned to them.

    People are reduced to one per shift before the dates come in; joining everybody
    with every date of their shift would multiply the two.
    """
    staff = employee.filter(same_text("type", "receptionist")).select("emp_id")
    lowest = emp_shift.join(staff, "emp_id").groupBy("shift_id").agg(F.min("emp_id").alias("emp_id"))
    return dated.join(lowest, "shift_id").select("emp_id", F.col("date").alias("_date"), "start_time", "end_time")


def with_receptionist(
    requests: DataFrame,
    employee: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    *,
    today_only: bool,
    wrap: bool = False,
) -> DataFrame:
    """Add ``receptionist_id``: lowest receptionist on shift at ``request_ts``.

    Only ``today_only`` looks at the date of the shift; the other form goes by the
    clock alone, whatever the date.
    """
    slots = receptionist_slots(employee, emp_shift, dated)
    keys = ["_date"] if today_only else []
    asked = requests.withColumns({"_clock": seconds_of_day("request_ts"), "_date": F.to_date("request_ts")})
    found = lowest_on_duty(asked, slots, keys, "_clock", "start_time", "end_time", ["emp_id"], "_desk", wrap)
    return found.withColumn("receptionist_id", F.col("_desk.emp_id")).drop("_desk", "_clock", "_date")


def department_doctor(requests: DataFrame, employee: DataFrame, weekly: DataFrame, dept_id: int, name: str) -> DataFrame:
    """Add ``name``: lowest employee of a department, given any weekly slot on that weekday.

    The slot need not belong to the employee: one slot of anybody is enough.
    """
    lowest = employee.filter(F.col("dept_id") == dept_id).agg(F.min("emp_id")).scalar()
    open_days = weekly.select(F.col("day").alias("_weekday")).distinct().withColumn("_open", F.lit(True))
    return (
        requests.withColumn("_weekday", weekday("request_ts"))
        .join(open_days, "_weekday", "left")
        .withColumn(name, F.when(F.col("_open"), lowest))
        .drop("_weekday", "_open")
    )


def duty_roster(weekly: DataFrame, at: Column, wrap: bool = False) -> DataFrame:
    """Weekly slots that cover one moment."""
    return weekly.filter(
        (F.col("day") == weekday(at)) & on_duty(seconds_of_day(at), "shift_start", "shift_end", wrap)
    )
