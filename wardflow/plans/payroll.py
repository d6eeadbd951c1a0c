"""Monthly payroll and salary raises."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.clock import within_month
from wardflow.functions.money import money, raised
from wardflow.functions.text import same_text
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure
from wardflow.operators.scan import fold
from wardflow.operators.snapshots import update_from
from wardflow.session import materialize

# Raises of a department in one list.
RAISES_PER_ROUND = 100_000


def monthly_salary(
    employee: DataFrame, salary: DataFrame, reward: DataFrame, deduction: DataFrame, month_date: Column
) -> DataFrame:
    """Salary table after the payroll run of ``month_date``.

    Active employees without a row at exactly that date get one; every row of that
    date then becomes base pay plus the month's rewards minus its deductions. Running
    it again changes nothing.

    All four inputs are stacked and summed up per employee: one shuffle, combined
    before it, instead of a join each. Employees are unique, as are (emp_id, date).
    """
    day = month_date.cast("date")
    columns = ["emp_id", "date", "salary", "total_reward", "total_deduction"]
    others = salary.filter(F.col("date") != day).select(*columns)

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("emp_id", *[value.alias(name) for name, value in values.items()])

    stacked = part(
        employee, base=money("salary", 18), active=same_text("status", "active")
    )
    for other in (
        part(
            salary.filter(F.col("date") == day),
            on_file=F.lit(True),
            old_salary=F.col("salary"),
            old_reward=F.col("total_reward"),
            old_deduction=F.col("total_deduction"),
        ),
        part(reward.filter(within_month("date", day)), rewarded=money("amount", 18)),
        part(deduction.filter(within_month("date", day)), deducted=money("amount", 18)),
    ):
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    sums = ("rewarded", "deducted")
    per_employee = stacked.groupBy("emp_id").agg(
        *[F.max(c).alias(c) for c in stacked.columns if c != "emp_id" and c not in sums],
        *[F.sum(c).alias(c) for c in sums],
    )
    zero = F.lit(0).cast("decimal(18,2)")
    known = F.col("base").isNotNull()
    plus, minus = F.coalesce("rewarded", zero), F.coalesce("deducted", zero)
    paid = per_employee.filter("on_file or active").select(
        "emp_id",
        day.alias("date"),
        money(F.when(known, F.col("base") + plus - minus).otherwise(F.col("old_salary")), 18).alias("salary"),
        money(F.when(known, plus).otherwise(F.col("old_reward")), 18).alias("total_reward"),
        money(F.when(known, minus).otherwise(F.col("old_deduction")), 18).alias("total_deduction"),
    )
    return others.unionByName(paid)


def salary_corrections(salary: DataFrame, reward: DataFrame, deduction: DataFrame) -> DataFrame:
    """Salary table after rewards and deductions that came in late for months already paid.

    Only the new rows are read: they are summed up per employee and month, and every salary row of that month
    changes by the sums. Months that are not paid yet have no row; their payroll run takes all rows.
    """
    zero = F.lit(0).cast("decimal(18,2)")

    def part(df: DataFrame, plus: Column, minus: Column) -> DataFrame:
        return df.select("emp_id", F.trunc("date", "MM").alias("_month"), plus.alias("_plus"), minus.alias("_minus"))

    amount = money("amount", 18)
    late = part(reward, amount, zero).unionByName(part(deduction, zero, amount))
    sums = late.groupBy("emp_id", "_month").agg(F.sum("_plus").alias("plus"), F.sum("_minus").alias("minus"))
    corrected = update_from(
        salary.withColumn("_month", F.trunc("date", "MM")),
        sums,
        ["emp_id", "_month"],
        {
            "salary": F.col("salary") + F.col("new_plus") - F.col("new_minus"),
            "total_reward": F.coalesce("total_reward", zero) + F.col("new_plus"),
            "total_deduction": F.coalesce("total_deduction", zero) + F.col("new_minus"),
        },
    )
    return corrected.select(*salary.columns)


def raise_by_employee(requests: DataFrame, employee: DataFrame) -> JobResult:
    """Percentage raises per employee, each rounded before the next is applied.

    Raises of one employee depend on each other, so they pass through a task in order
    (``scan.fold``). A raise the salary column cannot hold fails.
    """
    staff = employee.select(
        "emp_id", F.lit(True).alias("known"), same_text("status", "active").alias("active"), F.col("salary").alias("start")
    )
    state = requests.join(staff.select("emp_id", "known", "active"), "emp_id", "left").withColumn(
        "refused",
        first_failure(
            [
                (F.col("known").isNull(), "Employee does not exist."),
                (~F.coalesce("active", F.lit(False)), "Employee exists but is not active."),
                (F.col("increase_percent") <= 0, "Increase percent must be greater than zero."),
            ]
        ),
    )
    valid = state.filter("refused is null").select(
        "emp_id", *REQUEST_ORDER, money("increase_percent", 5).alias("percent")
    )
    salaries = valid.select("emp_id").distinct().join(staff.select("emp_id", "start"), "emp_id")
    final, overflowed = _compound(valid, salaries)
    outcomes = (
        state.join(overflowed.withColumn("overflow", F.lit(True)), "request_id", "left")
        .withColumn(
            "refused",
            F.coalesce("refused", F.when(F.col("overflow"), "Arithmetic overflow: salary out of range.")),
        )
        .select(
            "request_id",
            "emp_id",
            F.col("refused").isNull().alias("accepted"),
            F.coalesce("refused", F.lit("Salary has been successfully increased for the employee.")).alias("message"),
        )
    )
    return JobResult(outcomes, {"employee": update_from(employee, final, ["emp_id"], {"salary": "salary"})})


# Cents a salary column cannot hold.
_TOO_MUCH = 10**10


def _grown(cents: int | None, percent: Decimal | None) -> int | None:
    """One raise in cents, rounded half away from zero; None when the result does not fit the column."""
    if cents is None or percent is None:
        return None
    exact = cents * (10_000 + int(percent.scaleb(2)))
    rounded = (abs(exact) + 5_000) // 10_000 * (1 if exact >= 0 else -1)
    return rounded if rounded < _TOO_MUCH else None


def _compound(raises: DataFrame, salaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final salary per employee and the ids of raises that overflowed."""

    def start(row: dict) -> int | None:
        return None if row["start"] is None else int(row["start"].scaleb(2))

    def step(cents: int | None, row: dict) -> tuple[int | None, dict | None]:
        grown = _grown(cents, row["percent"])
        return (cents, {"request_id": row["request_id"]}) if grown is None else (grown, None)

    def finish(first: dict, cents: int | None) -> dict:
        return {"emp_id": first["emp_id"], "salary": None if cents is None else Decimal(cents).scaleb(-2)}

    exact = salaries.select("emp_id", F.col("start").cast("decimal(10,2)").alias("start"))
    schema = "request_id long, emp_id long, salary decimal(10,2)"
    told = materialize(fold(raises.join(exact, "emp_id"), ["emp_id"], REQUEST_ORDER, start, step, finish, schema), "raises")
    return told.filter("emp_id is not null").select("emp_id", "salary"), told.filter("request_id is not null").select("request_id")


def raise_by_department(requests: DataFrame, employee: DataFrame, department: DataFrame) -> JobResult:
    """Percentage raises for the active employees of a department, in batch order.

    Every employee of a department sees the same list of raises, so the list is built
    once per department and folded per employee. A raise is one statement: when the
    highest salary of the department would not fit, it fails for all.
    """
    active = employee.filter(same_text("status", "active")).groupBy("dept_id").agg(F.count("*").alias("staffed"))
    state = (
        requests.join(department.select("dept_id", F.lit(True).alias("known")), "dept_id", "left")
        .join(active, "dept_id", "left")
        .withColumn(
            "refused",
            first_failure(
                [
                    (F.col("known").isNull(), "Department does not exist."),
                    (F.col("staffed").isNull(), "No active employees found in this department."),
                    (F.col("increase_percent") <= 0, "Increase percent must be greater than zero."),
                ]
            ),
        )
    )
    valid = state.filter("refused is null").select(
        F.col("dept_id").alias("emp_id"), *REQUEST_ORDER, money("increase_percent", 5).alias("percent")
    )
    top = (
        employee.filter(same_text("status", "active"))
        .groupBy(F.col("dept_id").alias("emp_id"))
        .agg(F.max("salary").alias("start"))
        .join(valid.select("emp_id").distinct(), "emp_id", "left_semi")
    )
    _, overflowed = _compound(valid, top)
    served = valid.join(overflowed, "request_id", "left_anti")
    grown = _compound_many(served.withColumnRenamed("emp_id", "dept_id"), employee)
    outcomes = state.join(overflowed.withColumn("overflow", F.lit(True)), "request_id", "left").withColumn(
        "refused", F.coalesce("refused", F.when(F.col("overflow"), "Arithmetic overflow: salary out of range."))
    ).select(
        "request_id",
        "dept_id",
        F.col("refused").isNull().alias("accepted"),
        F.coalesce("refused", F.lit("Salaries have been successfully increased for this department.")).alias("message"),
    )
    return JobResult(outcomes, {"employee": grown})


# Parts of a department's staff, each grown in a task of its own.
_STAFF_PARTS = 8


def _grow(staff: pa.Table, lists: pa.Table) -> pa.Table:
    """One part of a department's staff after the department's raises; ``_cents`` NULL where nothing is due."""
    at = staff.column_names.index("_cents")
    if not lists.num_rows:
        return staff.set_column(at, "_cents", pa.nulls(staff.num_rows, pa.int64()))
    due = staff["_cents"].is_valid().to_numpy()
    start = staff["_cents"].drop_null().to_numpy()
    cents, most = np.abs(start), int(np.abs(start).max(initial=0))
    for factor in (10_000 + lists["_steps"][0].values.to_numpy()).tolist() if most else ():
        cents = (cents * factor + 5_000) // 10_000
        most = (most * factor + 5_000) // 10_000
        if most >= _TOO_MUCH:
            raise ArithmeticError("salary out of range")
    grown = np.zeros(staff.num_rows, "int64")
    grown[due] = cents * np.sign(start)
    return staff.set_column(at, "_cents", pa.array(grown, mask=~due))


def _compound_many(raises: DataFrame, employee: DataFrame) -> DataFrame:
    """Fold each department's raises over the salaries of its active employees.

    A raise is one step on all salaries of a part of the staff, in whole cents.
    """
    order = Window.partitionBy("dept_id").orderBy(*REQUEST_ORDER)
    columns, kind = employee.columns, employee.schema["salary"].dataType
    parts = F.array(*[F.lit(n) for n in range(_STAFF_PARTS)])
    while True:
        batch = raises.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= RAISES_PER_ROUND)
        lists = batch.groupBy("dept_id").agg(
            F.array_sort(F.collect_list(F.struct(*REQUEST_ORDER, (F.col("percent") * 100).cast("long").alias("step")))).alias("_steps"),
            F.max(F.struct(*REQUEST_ORDER)).alias("_last"),
            F.max("_n").alias("_taken"),
        )
        lists = materialize(lists.withColumn("_steps", F.col("_steps.step")), "raises")
        cents = F.when(same_text("status", "active"), (F.col("salary").cast("decimal(10,2)") * 100).cast("long"))
        part = F.pmod(F.xxhash64("emp_id"), F.lit(_STAFF_PARTS)).cast("int")
        staff = employee.withColumns({"_cents": cents, "_part": part})
        told = lists.select("dept_id", "_steps", F.explode(parts).alias("_part"))
        grown = staff.groupBy("dept_id", "_part").cogroup(told.groupBy("dept_id", "_part")).applyInArrow(_grow, staff.schema)
        stored = (F.col("_cents").cast("decimal(20,0)") / 100).cast("decimal(10,2)").cast(kind)
        employee = grown.withColumn("salary", F.coalesce(stored, "salary")).select(*columns)
        more = lists.filter(F.col("_taken") == RAISES_PER_ROUND).select("dept_id", "_last")
        if more.isEmpty():
            return employee
        raises = materialize(
            raises.join(more, "dept_id").filter(F.struct(*REQUEST_ORDER) > F.col("_last")).drop("_last"), "raises"
        )
        employee = materialize(employee, "raises")


def annual_raise(employee: DataFrame, percent: int = 10) -> JobResult:
    """Raise every active employee; the message says whether there was anyone."""
    kind = employee.schema["salary"].dataType
    rate = F.lit(percent).cast("decimal(5,2)")
    active = same_text("status", "active")
    grown = employee.withColumn(
        "salary", F.when(active, raised("salary", rate)).otherwise(F.col("salary")).cast(kind)
    )
    outcome = employee.agg(F.count(F.when(active, 1)).alias("raised")).select(
        "raised",
        F.when(F.col("raised") == 0, "No active employees found to apply annual increase.")
        .otherwise(f"Annual salary increase of {percent}% has been successfully applied.")
        .alias("message"),
    )
    return JobResult(outcome, {"employee": grown})
