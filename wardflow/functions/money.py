"""Amounts: rounding on store, daily pay, attendance penalties, room bills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.clock import at_least
from wardflow.functions.text import ColumnLike, col


def money(value: ColumnLike, precision: int = 10, scale: int = 2) -> Column:
    """Stored amount; the cast rounds half away from zero."""
    return col(value).cast(f"decimal({precision},{scale})")


def raised(salary: ColumnLike, percent: ColumnLike) -> Column:
    salary, percent = col(salary), col(percent)
    return money(salary + salary * percent / F.lit(100).cast("decimal(3,0)"))


def daily_pay(salary: ColumnLike) -> Column:
    """One thirtieth of the monthly salary, rounded to cents."""
    return money(money(salary, 18) / F.lit(30).cast("decimal(3,1)"), 18)


def penalty_amount(delay: ColumnLike, early: ColumnLike, salary: ColumnLike) -> Column:
    """Deduction for late arrival and early leave (both in minutes, not negative)."""
    delay, early, pay = col(delay), col(early), daily_pay(salary)
    tenth, half = F.lit("0.1").cast("decimal(2,1)"), F.lit("0.5").cast("decimal(2,1)")
    return (
        F.when((delay > 0) & (early > 0), pay)
        .when((delay > 0) & (delay < 60), money(pay * tenth, 18))
        .when(delay > 0, money(pay * half, 18))
        .when(early > 0, money(pay * half, 18))
    )


def penalty_label(delay: ColumnLike, early: ColumnLike) -> Column:
    delay, early = col(delay), col(early)
    return (
        F.when(
            (delay > 0) & (early > 0),
            F.format_string("Full day deduction: Delay (%d min) & Early Leave (%d min)", delay, early),
        )
        .when((delay > 0) & (delay < 60), F.format_string("Delay < 1h (%d min)", delay))
        .when(delay > 0, F.format_string("Delay >= 1h (%d min)", delay))
        .when(early > 0, F.format_string("Early Leave (%d min)", early))
    )


def stay_days(checkin: ColumnLike, checkout: ColumnLike) -> Column:
    """Billed days: calendar days, at least one."""
    return at_least(F.datediff(col(checkout), col(checkin)), 1)


def room_payment(checkin: ColumnLike, checkout: ColumnLike, price_per_day: ColumnLike) -> Column:
    return money(stay_days(checkin, checkout) * col(price_per_day))


def line_total(unit_price: ColumnLike, quantity: ColumnLike) -> Column:
    return money(col(unit_price) * col(quantity), 12)
