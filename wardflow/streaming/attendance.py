"""Attendance as event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardflow.functions.clock import at_time, weekday
from wardflow.functions.text import same_text
from wardflow.plans.attendance import end_offset

SALTS = 16


def first_check_ins(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """First check-in to arrive per employee and day.

    ``events``: emp_id, ts (TIMESTAMP), request_id. A crowded key is thinned out on
    several salts first, so that its rows do not all meet in one task.
    """
    keyed = (
        events.withWatermark("ts", delay)
        .withColumn("attend_date", F.to_date("ts"))
        .withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)))
    )
    return (
        keyed.dropDuplicatesWithinWatermark(["emp_id", "attend_date", "_salt"])
        .dropDuplicatesWithinWatermark(["emp_id", "attend_date"])
        .drop("_salt")
    )


def late_rows(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Rows that arrive behind the stream's watermark, which the stateful jobs leave out.

    ``events`` as for ``first_check_ins``, whose watermark this follows: both read the same files with
    the same delay. Rows are dealt by a hash of their id, so none is held and no key is crowded.
    """

    def behind(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for frame in frames:
            yield frame.loc[frame["ts"] <= mark].drop(columns="_salt")

    salted = events.withWatermark("ts", delay).withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)))
    return salted.groupBy("_salt").applyInPandasWithState(
        behind, events.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def with_late_check_ins(found: DataFrame, late: DataFrame) -> DataFrame:
    """The stream's check-ins (emp_id, attend_date, ts) and those of its late rows: the first per employee and day."""
    kept = late.select("emp_id", F.to_date("ts").alias("attend_date"), "ts")
    return found.select(*kept.columns).unionByName(kept).groupBy("emp_id", "attend_date").agg(F.min("ts").alias("ts"))


def with_shift_end(
    arrivals: DataFrame, employee: DataFrame, weekly: DataFrame, dated: DataFrame, emp_shift: DataFrame
) -> DataFrame:
    """Add the end of the day's shift: the first weekly slot to end for doctors, the
    assigned dated shift for everybody else. Days without a shift are left out.

    ``arrivals``: emp_id, attend_date. Every arrival meets the slots of its own day only.
    """
    doctor = same_text("type", "doctor")
    slots = weekly.groupBy("emp_id", F.col("day").alias("_weekday")).agg(
        F.min(end_offset("shift_start", "shift_end")).alias("_slot_end")
    )
    shifts = dated.select(
        "shift_id", F.col("date").alias("attend_date"), end_offset("start_time", "end_time").alias("_shift_end")
    )
    timed = (
        arrivals.withColumn("_weekday", weekday("attend_date"))
        .join(employee.select("emp_id", doctor.alias("_doctor")), "emp_id")
        .join(slots, ["emp_id", "_weekday"], "left")
        .join(emp_shift.select("emp_id", "shift_id"), "emp_id", "left")
        .join(shifts, ["shift_id", "attend_date"], "left")
        .withColumn("_offset", F.when(F.col("_doctor"), F.col("_slot_end")).otherwise(F.col("_shift_end")))
        .filter(F.col("_offset").isNotNull())
    )
    ends = at_time("attend_date", "_offset").cast("timestamp")
    return timed.select(*arrivals.columns, ends.alias("shift_end"))


def pair_check_outs(
    check_ins: DataFrame,
    check_outs: DataFrame,
    employee: DataFrame,
    weekly: DataFrame,
    dated: DataFrame,
    emp_shift: DataFrame,
    grace_minutes: int = 30,
    delay: str = "1 hour",
) -> DataFrame:
    """Check-ins with the check-outs of the same day up to shift end plus grace.

    A check-in without one is given out with a NULL check-out once the watermark has
    passed its deadline: that is the missing-checkout case. ``check_ins`` and
    ``check_outs``: emp_id, ts; days without a shift are left out.
    """
    grace = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes))
    dated_ins = check_ins.withWatermark("ts", delay).select(
        "emp_id", F.to_date("ts").alias("attend_date"), F.col("ts").alias("checkin")
    )
    arrivals = with_shift_end(dated_ins, employee, weekly, dated, emp_shift).alias("a")
    departures = (
        check_outs.withWatermark("ts", delay)
        .select("emp_id", F.to_date("ts").alias("attend_date"), F.col("ts").alias("checkout"))
        .alias("d")
    )
    return arrivals.join(
        departures,
        (F.col("a.emp_id") == F.col("d.emp_id"))
        & (F.col("a.attend_date") == F.col("d.attend_date"))
        & (F.col("d.checkout") >= F.col("a.checkin"))
        & (F.col("d.checkout") <= F.col("a.checkin") + F.expr("INTERVAL 2 DAYS"))
        & (F.col("d.checkout") <= F.col("a.shift_end") + grace),
        "left_outer",
    ).select("a.emp_id", "a.attend_date", "a.checkin", "a.shift_end", "d.checkout")


def settled_days(pairs: DataFrame) -> DataFrame:
    """One row per employee and day of the stream's output: earliest arrival and departure."""
    return (
        pairs.groupBy("emp_id", "attend_date")
        .agg(F.min("checkin").alias("checkin"), F.min("checkout").alias("checkout"), F.min("shift_end").alias("shift_end"))
        .withColumn("missing", F.col("checkout").isNull())
    )
