"""Attendance, payroll, shifts, departments and employees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, amount_text, clock, day, or_minus_one, replay_sql
from wardflow.functions.clock import moment
from wardflow.operators.catalogue import Messages
from wardflow.plans import attendance as att
from wardflow.plans import payroll, staffing
from wardflow.plans.diagnostics import NEGATIVE_PRICE
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

# ---------------------------------------------------------------- attendance


def calls(r: Roles) -> DataFrame:
    """Every event but a signup is a call at the clock."""
    return r.events.filter("event_type <> 'signup'").select("request_id", "request_ts", "emp_id")


CALLS = "calls AS (SELECT request_id, request_ts, emp_id, CAST(request_ts AS DATE) AS d FROM ev WHERE event_type <> 'signup')"

CHECK_IN = with_roles(
    "emp signup_days",
    f"""{CALLS},
    flags AS (SELECT c.*, e.emp_id IS NULL AS unknown, e.status = 'Inactive' AS inactive, s.emp_id IS NOT NULL AS present
              FROM calls c LEFT JOIN emp e ON c.emp_id = e.emp_id
              LEFT JOIN signup_days s ON s.emp_id = c.emp_id AND s.attend_date = c.d),
    placed AS (SELECT *, row_number() OVER (PARTITION BY emp_id, d, unknown, inactive, present
                                           ORDER BY request_ts, request_id) AS place FROM flags)""",
)


@registry.add(
    "attendance_checkin",
    CHECK_IN
    + f"""
    SELECT request_id, emp_id, {day('d')} AS attend_date,
           CASE WHEN unknown THEN 'Employee not found in the system'
                WHEN inactive THEN 'Employee is inactive and cannot check in'
                WHEN present OR place > 1 THEN 'Employee already checked in today'
                ELSE 'Check-in recorded successfully' END AS message,
           NOT unknown AND NOT coalesce(inactive, false) AND NOT present AND place = 1 AS accepted
    FROM placed""",
)
def attendance_checkin(r: Roles) -> DataFrame:
    return att.check_in(calls(r), r.employee, r.signups).outcomes


@registry.add(
    "attendance_checkin_table",
    CHECK_IN
    + f"""
    SELECT emp_id, {day('attend_date')} AS attend_date, {clock('checkin')} AS checkin, {clock('checkout')} AS checkout
    FROM signup_days
    UNION ALL SELECT emp_id, {day('d')}, {clock('request_ts')}, NULL FROM placed
    WHERE NOT unknown AND NOT inactive AND NOT present AND place = 1""",
)
def attendance_checkin_table(r: Roles) -> DataFrame:
    return att.check_in(calls(r), r.employee, r.signups).tables["attendance"]


_CHECK_OUTS = f"""{CALLS},
    flags AS (SELECT c.*, s.emp_id IS NULL AS absent, s.checkout IS NOT NULL AS closed
              FROM calls c LEFT JOIN signup_days s ON s.emp_id = c.emp_id AND s.attend_date = c.d),
    placed AS (SELECT *, row_number() OVER (PARTITION BY emp_id, d ORDER BY request_ts, request_id) AS place FROM flags)"""
CHECK_OUT = with_roles("signup_days", _CHECK_OUTS)


@registry.add(
    "attendance_checkout",
    CHECK_OUT
    + f"""
    SELECT request_id, emp_id, {day('d')} AS attend_date, NOT absent AND NOT closed AND place = 1 AS accepted,
           CASE WHEN absent THEN 'No check-in found for this employee today'
                WHEN closed OR place > 1 THEN 'Employee already checked out today'
                ELSE 'Checkout recorded successfully' END AS message
    FROM placed""",
)
def attendance_checkout(r: Roles) -> DataFrame:
    return att.check_out(calls(r), r.signups).outcomes


@registry.add(
    "attendance_checkout_table",
    CHECK_OUT
    + f"""
    SELECT s.emp_id, {day('s.attend_date')} AS attend_date, {clock('s.checkin')} AS checkin,
           {clock('coalesce(s.checkout, p.request_ts)')} AS checkout
    FROM signup_days s LEFT JOIN (SELECT * FROM placed WHERE NOT absent AND NOT closed AND place = 1) p
      ON p.emp_id = s.emp_id AND p.d = s.attend_date""",
)
def attendance_checkout_table(r: Roles) -> DataFrame:
    return att.check_out(calls(r), r.signups).tables["attendance"]


_SECONDS = "(hour({0}) * 3600 + minute({0}) * 60 + second({0}))"
_PENALTIES = f"""hours AS (
      SELECT a.*, e.type, e.cents, datediff('day', DATE '2024-01-01', a.attend_date) AS x,
             CASE WHEN lower(e.type) = 'doctor' THEN w.shift_start ELSE s.start_time END AS shift_start,
             CASE WHEN lower(e.type) = 'doctor' THEN w.shift_end ELSE s.end_time END AS shift_end
      FROM att a LEFT JOIN emp e ON a.emp_id = e.emp_id
      LEFT JOIN weekly w ON w.emp_id = a.emp_id AND w.day = dayname(a.attend_date)
      LEFT JOIN dated s ON s.date = a.attend_date AND s.shift_id = 1),
    late AS (
      SELECT *, greatest(0, {_SECONDS.format('checkin')} // 60 - shift_start // 60) AS delay,
             greatest(0, shift_end // 60 - {_SECONDS.format('checkout')} // 60) AS early,
             (cents + 15) // 30 AS pay FROM hours),
    judged AS (
      SELECT *, CASE WHEN type IS NULL THEN 'Employee not found'
                     WHEN shift_start IS NULL OR shift_end IS NULL THEN 'No shift found for this date'
                     WHEN checkin IS NULL THEN 'No attendance record found for this date'
                     WHEN checkout IS NULL THEN 'Employee did not check out'
                     WHEN delay = 0 AND early = 0 THEN 'No deduction — employee was on time' END AS open_message
      FROM late),
    charged AS (
      SELECT emp_id, attend_date, open_message,
             CASE WHEN open_message IS NOT NULL THEN NULL
                  WHEN delay > 0 AND early > 0 THEN 'Full day deduction: Delay (' || delay || ' min) & Early Leave (' || early || ' min)'
                  WHEN delay > 0 AND delay < 60 THEN 'Delay < 1h (' || delay || ' min)'
                  WHEN delay > 0 THEN 'Delay >= 1h (' || delay || ' min)'
                  ELSE 'Early Leave (' || early || ' min)' END AS type,
             CASE WHEN open_message IS NOT NULL THEN NULL
                  WHEN delay > 0 AND early > 0 THEN pay
                  WHEN delay > 0 AND delay < 60 THEN (pay + 5) // 10
                  ELSE (pay + 1) // 2 END AS cents
      FROM judged)"""
PENALTY = with_roles("att weekly dated", _PENALTIES)


@registry.add(
    "attendance_deduction",
    PENALTY
    + f"""
    SELECT emp_id, {day('attend_date')} AS attend_date, type, {amount('coalesce(cents, 0)')} AS amount,
           coalesce(open_message, 'Deduction applied: ' || type || ' - Amount: ' || {amount_text('cents')}) AS message
    FROM charged""",
)
def attendance_deduction(r: Roles) -> DataFrame:
    days = r.attendance
    found = att.attendance_deduction(days.select("emp_id", "attend_date"), days, r.employee, r.weekly, r.dated)
    return found.withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(18,2)")))


@registry.add(
    "attendance_deduction_table",
    PENALTY
    + f"""
    SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM ded d
    WHERE NOT EXISTS (SELECT 1 FROM charged c WHERE c.type IS NOT NULL AND c.emp_id = d.emp_id AND c.attend_date = d.date)
    UNION ALL SELECT emp_id, type, {day('attend_date')}, {amount('cents')} FROM charged WHERE type IS NOT NULL""",
)
def attendance_deduction_table(r: Roles) -> DataFrame:
    days = r.attendance
    found = att.attendance_deduction(days.select("emp_id", "attend_date"), days, r.employee, r.weekly, r.dated)
    return att.apply_attendance_deduction(found, r.deduction)


SQL["attendance_deduction_table"] = SQL["attendance_deduction_table"].replace(
    "WITH ", "WITH " + "ded AS (SELECT user_id * 12 AS emp_id, event_type AS type, CAST(ts AS DATE) AS date, "
    "CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'error'),\n", 1
)

@registry.add(
    "attendance_checkout_deductions",
    with_roles(
        "signup_days emp weekly dated ded",
        f"""{_CHECK_OUTS},
        closed_days AS (SELECT s.emp_id, s.attend_date, s.checkin, p.request_ts AS checkout FROM signup_days s
                        JOIN placed p ON p.emp_id = s.emp_id AND p.d = s.attend_date AND NOT absent AND NOT closed AND place = 1),
        {_PENALTIES.replace('FROM att a', 'FROM closed_days a')}
        SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM ded d
        WHERE NOT EXISTS (SELECT 1 FROM charged c WHERE c.type IS NOT NULL AND c.emp_id = d.emp_id AND c.attend_date = d.date)
        UNION ALL SELECT emp_id, type, {day('attend_date')}, {amount('cents')} FROM charged WHERE type IS NOT NULL""",
    ),
)
def attendance_checkout_deductions(r: Roles) -> DataFrame:
    """Checking out works out the day's deduction."""
    done = att.check_out_and_deduct(calls(r), r.signups, r.employee, r.weekly, r.dated, r.deduction)
    return done.tables["deduction"]


SWEEP = "2024-01-21 09:00:00"
MISSING = with_roles(
    "att weekly dated emp_shift ded",
    f"""timed AS (
      SELECT a.emp_id, a.attend_date, e.cents, w.shift_start AS s, w.shift_end AS t
      FROM att a JOIN emp e ON a.emp_id = e.emp_id JOIN weekly w ON w.emp_id = a.emp_id AND w.day = dayname(a.attend_date)
      WHERE a.checkout IS NULL AND lower(e.type) = 'doctor'
      UNION ALL
      SELECT a.emp_id, a.attend_date, e.cents, d.start_time, d.end_time
      FROM att a JOIN emp e ON a.emp_id = e.emp_id JOIN emp_shift x ON x.emp_id = a.emp_id
      JOIN dated d ON d.shift_id = x.shift_id AND d.date = a.attend_date
      WHERE a.checkout IS NULL AND lower(e.type) <> 'doctor'),
    ends AS (
      SELECT *, CAST(attend_date AS TIMESTAMP) + CASE WHEN t = 0 THEN to_seconds(86340)
                  WHEN t < s THEN to_seconds(86400 + t) ELSE to_seconds(t) END AS shift_end FROM timed),
    missed AS (SELECT * FROM ends WHERE shift_end + INTERVAL 30 MINUTE < TIMESTAMP '{SWEEP}')""",
)


def sweep(r: Roles):
    return att.missing_checkout(r.attendance, r.employee, r.weekly, r.dated, r.emp_shift, r.deduction, moment(SWEEP))


@registry.add(
    "missing_checkout",
    MISSING
    + f"""
    SELECT emp_id, {day('attend_date')} AS attend_date, {clock('shift_end')} AS shift_end,
           'No checkout - Full day deduction' AS type, {amount('(cents + 15) // 30')} AS amount FROM missed""",
)
def missing_checkout(r: Roles) -> DataFrame:
    return sweep(r).outcomes


@registry.add(
    "missing_checkout_attendance",
    MISSING
    + f"""
    SELECT a.emp_id, {day('a.attend_date')} AS attend_date, {clock('a.checkin')} AS checkin,
           {clock('coalesce(a.checkout, m.shift_end)')} AS checkout
    FROM att a LEFT JOIN missed m ON m.emp_id = a.emp_id AND m.attend_date = a.attend_date""",
)
def missing_checkout_attendance(r: Roles) -> DataFrame:
    return sweep(r).tables["attendance"]


@registry.add(
    "missing_checkout_deductions",
    MISSING
    + f"""
    SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM ded d
    WHERE NOT EXISTS (SELECT 1 FROM missed m WHERE m.emp_id = d.emp_id AND m.attend_date = d.date)
    UNION ALL SELECT emp_id, 'No checkout - Full day deduction', {day('attend_date')}, {amount('(cents + 15) // 30')} FROM missed""",
)
def missing_checkout_deductions(r: Roles) -> DataFrame:
    return sweep(r).tables["deduction"]


def amount_requests(r: Roles) -> DataFrame:
    """Events as manual amounts: up to 5 is taken off first, so some are not positive."""
    return r.events.select(
        "request_id",
        "request_ts",
        "emp_id",
        F.col("event_type").alias("type"),
        (F.col("amount") - 5).cast("decimal(18,2)").alias("amount"),
        F.when(F.col("event_type") != "view", F.to_date("request_ts")).alias("date"),
    )


TODAY = "2024-02-01 10:00:00"
AMOUNTS = """asked AS (SELECT ev.request_id, ev.emp_id, ev.event_type AS type, ev.cents - 500 AS cents,
              CASE WHEN event_type <> 'view' THEN CAST(request_ts AS DATE) ELSE DATE '2024-02-01' END AS date,
              e.emp_id IS NULL AS unknown, coalesce(e.status = 'Inactive', false) AS inactive
              FROM ev LEFT JOIN emp e ON ev.emp_id = e.emp_id)"""


@registry.add(
    "manual_deduction",
    with_roles(
        "ev emp",
        f"""{AMOUNTS}
        SELECT request_id, emp_id, NOT unknown AND NOT inactive AND cents > 0 AS accepted,
               CASE WHEN unknown THEN 'Employee not found' WHEN inactive THEN 'Employee is inactive and cannot add deduction'
                    WHEN cents <= 0 THEN 'Deduction amount must be greater than zero'
                    ELSE 'Manual deduction added successfully' END AS message FROM asked""",
    ),
)
def manual_deduction(r: Roles) -> DataFrame:
    return att.manual_deduction(amount_requests(r), r.employee, r.deduction, moment(TODAY)).outcomes


@registry.add(
    "manual_deduction_table",
    with_roles(
        "ev emp ded",
        f"""{AMOUNTS}
        SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM ded
        UNION ALL SELECT emp_id, 'Manual - ' || type, {day('date')}, {amount('cents')} FROM asked
        WHERE NOT unknown AND NOT inactive AND cents > 0""",
    ),
)
def manual_deduction_table(r: Roles) -> DataFrame:
    return att.manual_deduction(amount_requests(r), r.employee, r.deduction, moment(TODAY)).tables["deduction"]


@registry.add(
    "reward_insert",
    with_roles(
        "ev emp",
        f"""{AMOUNTS}
        SELECT request_id, emp_id, NOT unknown AND cents > 0 AS accepted,
               CASE WHEN unknown THEN 'Employee not found' WHEN cents <= 0 THEN 'Reward amount must be greater than zero'
                    ELSE 'Reward added successfully' END AS message FROM asked""",
    ),
)
def reward_insert(r: Roles) -> DataFrame:
    return att.add_reward(amount_requests(r), r.employee, r.reward, moment(TODAY)).outcomes


@registry.add(
    "reward_table",
    with_roles(
        "ev emp rew",
        f"""{AMOUNTS}
        SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM rew
        UNION ALL SELECT emp_id, type, {day('date')}, {amount('cents')} FROM asked WHERE NOT unknown AND cents > 0""",
    ),
)
def reward_table(r: Roles) -> DataFrame:
    return att.add_reward(amount_requests(r), r.employee, r.reward, moment(TODAY)).tables["reward"]


# The older form of the rule, by which inactive employees get no reward.


@registry.add(
    "reward_refuse_inactive",
    with_roles(
        "ev emp",
        f"""{AMOUNTS}
        SELECT request_id, emp_id, NOT unknown AND NOT inactive AND cents > 0 AS accepted,
               CASE WHEN unknown THEN 'Employee not found' WHEN inactive THEN 'Employee is inactive and cannot add reward'
                    WHEN cents <= 0 THEN 'Reward amount must be greater than zero'
                    ELSE 'Reward added successfully' END AS message FROM asked""",
    ),
)
def reward_refuse_inactive(r: Roles) -> DataFrame:
    return att.add_reward(amount_requests(r), r.employee, r.reward, moment(TODAY), refuse_inactive=True).outcomes


@registry.add(
    "reward_refuse_inactive_table",
    with_roles(
        "ev emp rew",
        f"""{AMOUNTS}
        SELECT emp_id, type, {day('date')} AS date, {amount('cents')} AS amount FROM rew
        UNION ALL SELECT emp_id, type, {day('date')}, {amount('cents')} FROM asked
        WHERE NOT unknown AND NOT inactive AND cents > 0""",
    ),
)
def reward_refuse_inactive_table(r: Roles) -> DataFrame:
    done = att.add_reward(amount_requests(r), r.employee, r.reward, moment(TODAY), refuse_inactive=True)
    return done.tables["reward"]


# ------------------------------------------------------------------- payroll

MONTH = "2024-01-01"


def salaries(r: Roles) -> DataFrame:
    """Salary rows on file: one segment of employees already has the month's row."""
    zero = F.lit(0).cast("decimal(18,2)")
    return r.employee.filter("lname = 'HOUSEHOLD'").select(
        "emp_id", F.lit(MONTH).cast("date").alias("date"), F.col("salary").cast("decimal(18,2)"), zero, zero
    ).toDF("emp_id", "date", "salary", "total_reward", "total_deduction")


MONTHLY_SALARY = with_roles(
        "emp rew ded",
        f"""paid AS (SELECT emp_id, cents FROM emp WHERE lname = 'HOUSEHOLD' OR lower(status) = 'active'),
        r AS (SELECT emp_id, sum(cents) AS c FROM rew WHERE date >= DATE '{MONTH}' AND date < DATE '2024-02-01' GROUP BY 1),
        d AS (SELECT emp_id, sum(cents) AS c FROM ded WHERE date >= DATE '{MONTH}' AND date < DATE '2024-02-01' GROUP BY 1)
        SELECT p.emp_id, '{MONTH}' AS date, {amount('p.cents + coalesce(r.c, 0) - coalesce(d.c, 0)')} AS salary,
               {amount('coalesce(r.c, 0)')} AS total_reward, {amount('coalesce(d.c, 0)')} AS total_deduction
        FROM paid p LEFT JOIN r ON p.emp_id = r.emp_id LEFT JOIN d ON p.emp_id = d.emp_id""",
    )


@registry.add("monthly_salary", MONTHLY_SALARY)
def monthly_salary(r: Roles) -> DataFrame:
    return payroll.monthly_salary(r.employee, salaries(r), r.reward, r.deduction, F.lit(MONTH))


@registry.add("payroll_corrections", MONTHLY_SALARY)
def payroll_corrections(r: Roles) -> DataFrame:
    """The month paid without a fifth of rewards and deductions, which then come in late."""
    late = F.pmod(F.xxhash64("emp_id", "date", "amount"), F.lit(5)) == 0
    paid = payroll.monthly_salary(r.employee, salaries(r), r.reward.filter(~late), r.deduction.filter(~late), F.lit(MONTH))
    return payroll.salary_corrections(paid, r.reward.filter(late), r.deduction.filter(late))


def raise_requests(r: Roles) -> DataFrame:
    """Events as raises between -0.03 % and +0.36 %."""
    percent = ((F.col("request_id") % 40 - 3).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(5,2)")
    return r.events.select("request_id", "request_ts", "emp_id", percent.alias("increase_percent"))


# In cents and hundredths of a percent: salary + salary * p / 10000, rounded half up.
_FOLD = """list_reduce(list_prepend(e.cents, p.steps), lambda acc, x: acc + (acc * x + 5000) // 10000)"""


@registry.add(
    "raise_by_employee",
    with_roles(
        "ev emp",
        f"""steps AS (SELECT emp_id, list(request_id % 40 - 3 ORDER BY request_ts, request_id) AS steps
                      FROM ev WHERE request_id % 40 - 3 > 0 GROUP BY emp_id)
        SELECT e.emp_id, {amount(f"CASE WHEN e.status = 'active' AND p.steps IS NOT NULL THEN {_FOLD} ELSE e.cents END")} AS salary
        FROM emp e LEFT JOIN steps p ON p.emp_id = e.emp_id""",
    ),
)
def raise_by_employee(r: Roles) -> DataFrame:
    result = payroll.raise_by_employee(raise_requests(r), r.employee.select("emp_id", "salary", "status"))
    return result.tables["employee"].select("emp_id", "salary")


@registry.add(
    "raise_by_employee_outcomes",
    with_roles(
        "ev emp",
        """SELECT ev.request_id, ev.emp_id, e.status = 'active' IS TRUE AND ev.request_id % 40 - 3 > 0 AS accepted,
               CASE WHEN e.emp_id IS NULL THEN 'Employee does not exist.'
                    WHEN e.status <> 'active' THEN 'Employee exists but is not active.'
                    WHEN ev.request_id % 40 - 3 <= 0 THEN 'Increase percent must be greater than zero.'
                    ELSE 'Salary has been successfully increased for the employee.' END AS message
        FROM ev LEFT JOIN emp e ON ev.emp_id = e.emp_id""".replace(
            "e.status = 'active' IS TRUE AND", "coalesce(e.status = 'active', false) AND"
        ),
    ),
)
def raise_by_employee_outcomes(r: Roles) -> DataFrame:
    return payroll.raise_by_employee(raise_requests(r), r.employee.select("emp_id", "salary", "status")).outcomes


def department_raises(r: Roles) -> DataFrame:
    return raise_requests(r).withColumn("dept_id", (F.col("emp_id") / 12 % 30).cast("int")).drop("emp_id")


@registry.add(
    "raise_by_department",
    with_roles(
        "ev emp",
        f"""steps AS (SELECT emp_id // 12 % 30 AS dept_id, list(request_id % 40 - 3 ORDER BY request_ts, request_id) AS steps
                      FROM ev WHERE request_id % 40 - 3 > 0 GROUP BY 1)
        SELECT e.emp_id, e.dept_id,
               {amount(f"CASE WHEN e.status = 'active' AND p.steps IS NOT NULL THEN {_FOLD} ELSE e.cents END")} AS salary
        FROM emp e LEFT JOIN steps p ON p.dept_id = e.dept_id""",
    ),
)
def raise_by_department(r: Roles) -> DataFrame:
    staff = r.employee.select("emp_id", "dept_id", "salary", "status")
    result = payroll.raise_by_department(department_raises(r), staff, r.department)
    return result.tables["employee"].select("emp_id", "dept_id", "salary")


@registry.add(
    "raise_by_department_outcomes",
    with_roles(
        "ev emp dept",
        """asked AS (SELECT request_id, emp_id // 12 % 30 AS dept_id, request_id % 40 - 3 AS p FROM ev),
        staffed AS (SELECT DISTINCT dept_id FROM emp WHERE status = 'active')
        SELECT a.request_id, a.dept_id, d.dept_id IS NOT NULL AND s.dept_id IS NOT NULL AND p > 0 AS accepted,
               CASE WHEN d.dept_id IS NULL THEN 'Department does not exist.'
                    WHEN s.dept_id IS NULL THEN 'No active employees found in this department.'
                    WHEN p <= 0 THEN 'Increase percent must be greater than zero.'
                    ELSE 'Salaries have been successfully increased for this department.' END AS message
        FROM asked a LEFT JOIN dept d ON a.dept_id = d.dept_id LEFT JOIN staffed s ON s.dept_id = a.dept_id""",
    ),
)
def raise_by_department_outcomes(r: Roles) -> DataFrame:
    staff = r.employee.select("emp_id", "dept_id", "salary", "status")
    return payroll.raise_by_department(department_raises(r), staff, r.department).outcomes


@registry.add(
    "annual_raise",
    with_roles(
        "emp",
        f"""SELECT emp_id, status,
            {amount("CASE WHEN status = 'active' THEN cents + (cents * 10 + 50) // 100 ELSE cents END")} AS salary FROM emp""",
    ),
)
def annual_raise(r: Roles) -> DataFrame:
    return payroll.annual_raise(r.employee.select("emp_id", "status", "salary")).tables["employee"]


# ----------------------------------------------------------- shifts, schedule


@registry.add(
    "repeat_schedule",
    with_roles(
        "order_shifts",
        f"""last AS (SELECT date_trunc('month', max(date)) AS m FROM order_shifts),
        span AS (SELECT m, m + INTERVAL 1 MONTH AS n, day(last_day(m)) AS old_days, day(last_day(m + INTERVAL 1 MONTH)) AS new_days FROM last),
        copies AS (
          SELECT s.shift_id, s.shift_type, CAST(n AS DATE) + CAST(day(date) - 1 AS INTEGER) AS date, start_time, end_time
          FROM order_shifts s, span WHERE date >= m AND day(date) <= new_days
          UNION ALL
          SELECT s.shift_id, s.shift_type, CAST(n AS DATE) + CAST(old_days AS INTEGER), start_time, end_time
          FROM order_shifts s, span WHERE date >= m AND new_days > old_days AND day(date) = old_days - 1)
        SELECT shift_id, shift_type, {day('date')} AS date, start_time, end_time FROM order_shifts
        UNION ALL SELECT shift_id, shift_type, {day('date')}, start_time, end_time FROM copies""",
    ),
)
def repeat_schedule(r: Roles) -> DataFrame:
    return staffing.repeat_schedule(r.order_shifts)


@registry.add(
    "repeat_schedule_message",
    with_roles(
        "order_shifts",
        """SELECT count(*) > 0 AS accepted, CASE WHEN count(*) = 0 THEN 'No previous shifts found to copy.'
             ELSE 'Shift appointments have been repeated successfully for the next month.' END AS message FROM order_shifts""",
    ),
)
def repeat_schedule_message(r: Roles) -> DataFrame:
    return staffing.repeat_schedule_outcome(r.order_shifts)


@registry.add(
    "repeat_schedule_longer_month",
    with_roles(
        "dated",
        f"""moved AS (SELECT shift_id, shift_type, date + 30 AS date, start_time, end_time FROM dated),
        last AS (SELECT date_trunc('month', max(date)) AS m FROM moved),
        span AS (SELECT m, m + INTERVAL 1 MONTH AS n, day(last_day(m)) AS old_days, day(last_day(m + INTERVAL 1 MONTH)) AS new_days FROM last)
        SELECT shift_id, shift_type, {day('date')} AS date, start_time, end_time FROM moved
        UNION ALL
          SELECT s.shift_id, s.shift_type, {day('CAST(n AS DATE) + CAST(day(date) - 1 AS INTEGER)')}, start_time, end_time
          FROM moved s, span WHERE date >= m AND day(date) <= new_days
        UNION ALL
          SELECT s.shift_id, s.shift_type, {day('CAST(n AS DATE) + CAST(old_days AS INTEGER)')}, start_time, end_time
          FROM moved s, span WHERE date >= m AND new_days > old_days AND day(date) = old_days - 1""",
    ),
)
def repeat_schedule_longer_month(r: Roles) -> DataFrame:
    return staffing.repeat_schedule(r.dated.withColumn("date", F.date_add("date", 30)))


def catalogue_sql(state: str, asked: str, texts: Messages, price_rule: bool = False) -> str:
    """SQL for a mixed batch on a master table, request after request.

    ``state``: (id, name); ``asked``: (request_id, request_ts, action, id, name, price, used).
    """
    missing = f"WHEN me IS NULL THEN '{texts.missing}'"
    held = f"WHEN q.id IS NOT NULL AND f.others > 0 THEN '{texts.name_taken}'"
    tests = f"{missing} {held}" if texts.missing_first else f"{held} {missing}"
    no_id = f"WHEN q.id IS NULL THEN '{texts.id_required}'" if texts.id_required else ""
    price = f"WHEN q.price < 0 THEN '{NEGATIVE_PRICE}'" if price_rule else ""
    in_use = f"WHEN q.used THEN '{texts.in_use}'" if texts.in_use else ""
    return replay_sql(
        state,
        {"id": "BIGINT", "name": "VARCHAR"},
        asked,
        {"id": "BIGINT", "name": "VARCHAR", "price": "BIGINT", "used": "BOOLEAN"},
        {"others": "len(list_filter(st, lambda x: lower(x.name) = lower(q.name) AND x.id IS DISTINCT FROM q.id))"},
        f"""CASE q.action
          WHEN 'insert' THEN CASE WHEN f.others > 0 THEN '{texts.name_exists}' {price} END
          WHEN 'update' THEN CASE {no_id} {tests} END
          ELSE CASE {missing} {in_use} END END""",
        {"name": "coalesce(q.name, me.name)"},
        {"insert": texts.inserted, "update": texts.updated, "delete": texts.deleted},
    )


def batch_action(r: Roles) -> Column:
    """Every event changes a master table: signups and purchases add, views and clicks change, errors delete."""
    kind = F.col("event_type")
    return F.when(kind.isin("signup", "purchase"), "Insert").when(kind.isin("view", "click"), "UPDATE").otherwise("delete")


BATCH_ACTION = """CASE WHEN event_type IN ('signup', 'purchase') THEN 'insert' WHEN event_type IN ('view', 'click') THEN 'update'
                  ELSE 'delete' END AS action"""


def shift_requests(r: Roles) -> DataFrame:
    kind, number = F.lower("action"), F.col("emp_id") / 12
    return r.events.withColumn("action", batch_action(r)).select(
        "request_id",
        "request_ts",
        "action",
        F.when(kind != "insert", (F.col("request_id") % 40).cast("int")).alias("shift_id"),
        F.when(kind == "insert", F.concat(F.lit("Nation_"), (number % 45).cast("int").cast("string")))
        .when(kind == "update", F.concat(F.lit("Ward "), (number % 60).cast("int").cast("string")))
        .alias("shift_name"),
    )


SHIFT_CHANGES = with_roles(
    "ev emp",
    catalogue_sql(
        "SELECT n_nationkey AS id, n_name AS name FROM nation",
        f"""SELECT request_id, request_ts, action, CASE WHEN action <> 'insert' THEN request_id % 40 END AS id,
              CASE action WHEN 'insert' THEN 'Nation_' || (emp_id // 12 % 45) WHEN 'update' THEN 'Ward ' || (emp_id // 12 % 60) END AS name,
              0 AS price, request_id % 40 IN (SELECT dept_id * 2 FROM emp) AS used
            FROM (SELECT *, {BATCH_ACTION} FROM ev)""",
        staffing.SHIFT_TEXTS,
    ),
)


def shift_batch(r: Roles):
    shifts = r.table("nation").select(F.col("n_nationkey").alias("shift_id"), F.col("n_name").alias("shift_name"))
    used = r.employee.select("emp_id", (F.col("dept_id") * 2).alias("shift_id"))
    return staffing.shift_changes(shift_requests(r), shifts, used)


@registry.add(
    "shift_changes",
    SHIFT_CHANGES + "\nSELECT request_id, accepted, message, coalesce(id, -1) AS shift_id FROM outcomes",
)
def shift_changes(r: Roles) -> DataFrame:
    return shift_batch(r).outcomes.withColumns(or_minus_one("shift_id"))


@registry.add("shift_changes_table", SHIFT_CHANGES + "\nSELECT id AS shift_id, name AS shift_name FROM final")
def shift_changes_table(r: Roles) -> DataFrame:
    return shift_batch(r).tables["shift"]


def shift_moves(r: Roles, kinds: tuple[str, ...]) -> DataFrame:
    """Events as requests for a shift (1 to 4, of which the fourth does not exist)."""
    return r.events.filter(F.col("event_type").isin(*kinds)).select(
        "request_id", "request_ts", "emp_id", (F.col("request_id") % 4 + 1).cast("int").alias("shift_id")
    )


def shift_list(r: Roles) -> DataFrame:
    return r.dated.select("shift_id", F.col("shift_type").alias("shift_name")).distinct()


def some_assigned(r: Roles) -> DataFrame:
    """Only nurses are assigned yet."""
    nurses = r.employee.filter("type = 'nurse'").select("emp_id")
    return r.emp_shift.join(nurses, "emp_id", "left_semi")


_NURSES = "held AS (SELECT emp_id, emp_id % 3 + 1 AS shift_id FROM emp WHERE type = 'nurse')"
_MOVES = """asked AS (SELECT v.request_id, v.request_ts, v.emp_id, v.request_id % 4 + 1 AS shift_id,
               e.emp_id IS NULL AS unknown, coalesce(e.status = 'Inactive', false) AS inactive
             FROM ev v LEFT JOIN emp e ON v.emp_id = e.emp_id WHERE v.event_type IN ({kinds}))"""
_SHIFT_GUARDS = """CASE WHEN unknown THEN 'This employee does not exist'
                  WHEN inactive THEN 'This employee is inactive and cannot be assigned to a shift'
                  WHEN shift_id > 3 THEN '{missing}' END"""


ASSIGN = with_roles(
    "ev emp",
    f"""{_NURSES},
    {_MOVES.format(kinds="'signup', 'view'")},
    tested AS (SELECT a.*, {_SHIFT_GUARDS.format(missing='This shift does not exist').replace('shift_id', 'a.shift_id')} AS refused, h.shift_id AS held
               FROM asked a LEFT JOIN held h ON h.emp_id = a.emp_id),
    given AS (SELECT emp_id, arg_min(shift_id, (request_ts, request_id)) AS shift_id, arg_min(request_id, (request_ts, request_id)) AS winner
              FROM tested WHERE refused IS NULL AND held IS NULL GROUP BY 1)""",
)


@registry.add(
    "shift_assignment",
    ASSIGN
    + """
    SELECT t.request_id, coalesce(g.winner = t.request_id, false) AS accepted,
           coalesce(refused, CASE WHEN g.winner = t.request_id THEN '✅ Employee assigned to shift successfully'
             ELSE 'This employee is already assigned to shift number ' || coalesce(t.held, g.shift_id)
                  || ' and cannot be assigned to another shift.' END) AS message
    FROM tested t LEFT JOIN given g ON g.emp_id = t.emp_id""",
)
def shift_assignment(r: Roles) -> DataFrame:
    asked = shift_moves(r, ("signup", "view"))
    return staffing.assign_shift(asked, r.employee, shift_list(r), some_assigned(r)).outcomes


@registry.add(
    "shift_assignment_table",
    ASSIGN + "\nSELECT emp_id, shift_id FROM held UNION ALL SELECT emp_id, shift_id FROM given",
)
def shift_assignment_table(r: Roles) -> DataFrame:
    asked = shift_moves(r, ("signup", "view"))
    return staffing.assign_shift(asked, r.employee, shift_list(r), some_assigned(r)).tables["emp_shift"]


MOVE = with_roles(
    "ev emp emp_shift",
    f"""{_MOVES.format(kinds="'click', 'error'")},
    tested AS (SELECT a.*, {_SHIFT_GUARDS.format(missing='The new shift does not exist').replace('shift_id', 'a.shift_id')} AS refused, h.shift_id AS held
               FROM asked a LEFT JOIN emp_shift h ON h.emp_id = a.emp_id),
    line AS (SELECT *, CASE WHEN held IS NOT NULL THEN coalesce(lag(shift_id) OVER (PARTITION BY emp_id ORDER BY request_ts, request_id), held) END AS current
             FROM tested WHERE refused IS NULL)""",
)


@registry.add(
    "shift_move",
    MOVE
    + """
    SELECT t.request_id, t.refused IS NULL AND NOT coalesce(l.current = l.shift_id, false) AS accepted,
           coalesce(t.refused, CASE WHEN l.current = l.shift_id THEN 'This employee already exists in this shift'
                               ELSE 'Shift has been modified successfully' END) AS message
    FROM tested t LEFT JOIN line l ON l.request_id = t.request_id""",
)
def shift_move(r: Roles) -> DataFrame:
    asked = shift_moves(r, ("click", "error"))
    return staffing.move_shift(asked, r.employee, shift_list(r), r.emp_shift).outcomes


@registry.add(
    "shift_move_table",
    MOVE
    + """
    SELECT h.emp_id, coalesce(l.shift_id, h.shift_id) AS shift_id FROM emp_shift h LEFT JOIN
      (SELECT emp_id, arg_max(shift_id, (request_ts, request_id)) AS shift_id FROM line GROUP BY 1) l ON l.emp_id = h.emp_id""",
)
def shift_move_table(r: Roles) -> DataFrame:
    asked = shift_moves(r, ("click", "error"))
    return staffing.move_shift(asked, r.employee, shift_list(r), r.emp_shift).tables["emp_shift"]


@registry.add(
    "shift_unassign",
    with_roles(
        "ev emp_shift",
        """asked AS (SELECT request_id, request_ts, emp_id, request_id % 4 + 1 AS shift_id FROM ev WHERE event_type = 'purchase'),
        placed AS (SELECT a.*, h.emp_id IS NOT NULL AS known,
                   row_number() OVER (PARTITION BY a.emp_id, a.shift_id ORDER BY request_ts, request_id) AS place
                   FROM asked a LEFT JOIN emp_shift h ON h.emp_id = a.emp_id AND h.shift_id = a.shift_id)
        SELECT request_id, known AND place = 1 AS accepted,
               CASE WHEN known AND place = 1 THEN 'Employee has been deleted from the shift successfully'
                    ELSE 'Emp_id and shift_id mismatched' END AS message FROM placed""",
    ),
)
def shift_unassign(r: Roles) -> DataFrame:
    return staffing.unassign_shift(shift_moves(r, ("purchase",)), r.emp_shift).outcomes


# ------------------------------------------------- departments and employees


def department_adds(r: Roles) -> DataFrame:
    number = (F.col("emp_id") / 12).cast("long")
    return r.events.select(
        "request_id",
        "request_ts",
        F.concat(F.lit("nation_"), (number % 60 + 10).cast("string")).alias("dept_name"),
        F.when(F.col("amount") > 2, F.col("request_id") % 1700).alias("manager_id"),
    )


def rounds_sql(source: str, claims: tuple[str, ...]) -> str:
    """SQL for serving (k, claims…) rows in order: definitions ``tries`` and ``won``.

    Each round accepts the rows that are first for all their claims and drops the
    rows that share a claim with them.
    """
    names = ", ".join(claims)
    first = " AND ".join(f"({c} IS NULL OR k = min(CASE WHEN state = 0 THEN k END) OVER (PARTITION BY {c}))" for c in claims)
    clash = " OR ".join(f"({c} IS NOT NULL AND bool_or(wins) OVER (PARTITION BY {c}))" for c in claims)
    return f"""tries AS (
      SELECT 0 AS round, k, {names}, 0 AS state FROM {source}
      UNION ALL
      SELECT round + 1, k, {names}, CASE WHEN state <> 0 THEN state WHEN wins THEN 1 WHEN {clash} THEN 2 ELSE 0 END
      FROM (SELECT *, state = 0 AND {first} AS wins, bool_or(state = 0) OVER () AS going FROM tries) WHERE going),
    won AS (SELECT DISTINCT k, {names} FROM tries WHERE state = 1)"""


@registry.add(
    "department_add",
    with_roles(
        "ev emp dept",
        f"""asked AS (SELECT request_id, (request_ts, request_id) AS k, 'nation_' || (emp_id // 12 % 60 + 10) AS n,
                  CASE WHEN cents > 200 THEN request_id % 1700 END AS m FROM ev),
        tested AS (SELECT a.*, CASE WHEN d.dept_id IS NOT NULL THEN 'This department name already exists'
                 WHEN a.m IS NOT NULL AND e.emp_id IS NULL THEN 'Manager ID not found in Employee table'
                 WHEN e.status IS NULL OR e.status <> 'active' THEN 'This manager is inactive can not be a manager'
                 WHEN b.dept_id IS NOT NULL THEN 'This manager is already assigned to another department' END AS refused
               FROM asked a LEFT JOIN dept d ON lower(d.dept_name) = a.n LEFT JOIN emp e ON e.emp_id = a.m LEFT JOIN dept b ON b.manager_id = a.m),
        open AS (SELECT * FROM tested WHERE refused IS NULL),
        {rounds_sql('open', ('n', 'm'))},
        made AS (SELECT k, n, row_number() OVER (ORDER BY k) + (SELECT max(dept_id) FROM dept) AS dept_id FROM won)
        SELECT t.request_id, i.dept_id IS NOT NULL AS accepted, coalesce(i.dept_id, -1) AS dept_id,
               CASE WHEN i.dept_id IS NOT NULL THEN 'Department added successfully' WHEN x.k < t.k THEN 'This department name already exists'
                    ELSE coalesce(refused, 'This manager is already assigned to another department') END AS message
        FROM tested t LEFT JOIN made i ON i.k = t.k LEFT JOIN won x ON x.n = t.n""",
        recursive=True,
    ),
)
def department_add(r: Roles) -> DataFrame:
    """Two rules at once, served in order; the tests compare it with a plain loop as well."""
    return staffing.add_departments(department_adds(r), r.department, r.employee).outcomes.withColumns(
        or_minus_one("dept_id")
    )


def department_requests(r: Roles) -> DataFrame:
    number = (F.col("emp_id") / 12).cast("long")
    return r.events.select(
        "request_id",
        "request_ts",
        batch_action(r).alias("action"),
        (F.col("request_id") % 60).cast("int").alias("dept_id"),
        F.concat(F.lit("NATION_"), (number % 70).cast("string")).alias("dept_name"),
        F.when(F.col("amount") > 2, F.col("request_id") % 1700).alias("manager_id"),
    )


def department_sql(action: str) -> str:
    """SQL for departments, request after request; ``action`` as a column."""
    manager = """CASE WHEN q.manager_id IS NOT NULL AND NOT q.known THEN 'Manager ID not found in Employee table'
          WHEN NOT q.active THEN 'This manager is inactive can not be a manager'
          WHEN f.manages > 0 THEN 'This manager is already assigned to another department' END"""
    return with_roles(
        "ev emp dept",
        replay_sql(
            "SELECT dept_id AS id, dept_name AS name, manager_id FROM dept",
            {"id": "BIGINT", "name": "VARCHAR", "manager_id": "BIGINT"},
            f"""SELECT a.*, e.emp_id IS NOT NULL AS known, coalesce(lower(e.status) = 'active', false) AS active,
                  id IN (SELECT dept_id FROM emp) AS staffed
                FROM (SELECT request_id, request_ts, {action}, request_id % 60 AS id, 'NATION_' || (emp_id // 12 % 70) AS name,
                        CASE WHEN cents > 200 THEN request_id % 1700 END AS manager_id FROM ev) a
                LEFT JOIN emp e ON e.emp_id = a.manager_id""",
            {"id": "BIGINT", "name": "VARCHAR", "manager_id": "BIGINT", "known": "BOOLEAN", "active": "BOOLEAN", "staffed": "BOOLEAN"},
            {
                "others": "len(list_filter(st, lambda x: lower(x.name) = lower(q.name) AND (q.action = 'insert' OR x.id <> q.id)))",
                "manages": "len(list_filter(st, lambda x: x.manager_id = q.manager_id))",
            },
            f"""CASE q.action
              WHEN 'insert' THEN CASE WHEN f.others > 0 THEN 'This department name already exists' ELSE {manager} END
              WHEN 'update' THEN CASE WHEN me IS NULL THEN 'Department not found'
                WHEN f.others > 0 THEN 'This department name is already used by another department' ELSE {manager} END
              ELSE CASE WHEN me IS NULL THEN 'Department not found' WHEN q.staffed THEN 'Cannot delete department with assigned employees' END END""",
            {"name": "q.name", "manager_id": "q.manager_id"},
            {"insert": "Department added successfully", "update": "Department updated successfully", "delete": "Department deleted successfully"},
        ),
    )


@registry.add("department_changes", department_sql(BATCH_ACTION) + "\nSELECT request_id, accepted, message, coalesce(id, -1) AS dept_id FROM outcomes")
def department_changes(r: Roles) -> DataFrame:
    """Departments added, changed and deleted in one batch."""
    return staffing.department_changes(department_requests(r), r.department, r.employee).outcomes.withColumns(or_minus_one("dept_id"))


@registry.add(
    "department_changes_table",
    department_sql(BATCH_ACTION) + "\nSELECT id AS dept_id, name AS dept_name, coalesce(manager_id, -1) AS manager_id FROM final",
)
def department_changes_table(r: Roles) -> DataFrame:
    rows = staffing.department_changes(department_requests(r), r.department, r.employee).tables["department"]
    return rows.withColumns(or_minus_one("manager_id")).select("dept_id", "dept_name", "manager_id")


@registry.add("department_update", department_sql("'update' AS action") + "\nSELECT request_id, accepted, message, id AS dept_id FROM outcomes")
def department_update(r: Roles) -> DataFrame:
    return staffing.update_departments(department_requests(r).drop("action"), r.department, r.employee).outcomes


@registry.add(
    "department_update_table",
    department_sql("'update' AS action") + "\nSELECT id AS dept_id, name AS dept_name, coalesce(manager_id, -1) AS manager_id FROM final",
)
def department_update_table(r: Roles) -> DataFrame:
    rows = staffing.update_departments(department_requests(r).drop("action"), r.department, r.employee).tables["department"]
    return rows.withColumns(or_minus_one("manager_id")).select("dept_id", "dept_name", "manager_id")


@registry.add(
    "department_delete",
    with_roles(
        "ev emp dept",
        """asked AS (SELECT request_id, request_ts, request_id % 60 AS dept_id FROM ev),
        used AS (SELECT DISTINCT dept_id * 2 AS dept_id FROM emp),
        p AS (SELECT a.*, d.dept_id IS NOT NULL AS known, u.dept_id IS NOT NULL AS used,
                     row_number() OVER (PARTITION BY a.dept_id ORDER BY request_ts, request_id) AS place
              FROM asked a LEFT JOIN dept d ON d.dept_id = a.dept_id LEFT JOIN used u ON u.dept_id = a.dept_id)
        SELECT request_id, dept_id, known AND NOT used AND place = 1 AS accepted,
               CASE WHEN NOT known THEN 'Department not found' WHEN used THEN 'Cannot delete department with assigned employees'
                    WHEN place = 1 THEN 'Department deleted successfully' ELSE 'Department not found' END AS message FROM p""",
    ),
)
def department_delete(r: Roles) -> DataFrame:
    asked = r.events.select("request_id", "request_ts", (F.col("request_id") % 60).cast("int").alias("dept_id"))
    members = r.employee.withColumn("dept_id", F.col("dept_id") * 2)
    return staffing.delete_departments(asked, r.department, members).outcomes


def applicants(r: Roles) -> DataFrame:
    """Events as applications: ssn, phone and email follow from different numbers and so collide."""
    number = F.col("request_id")
    person = (F.col("emp_id") / 12).cast("long")
    return r.events.select(
        "request_id",
        "request_ts",
        F.lit("New").alias("fname"),
        F.lit("Hire").alias("lname"),
        F.concat(F.lit("s"), (number % 4000).cast("string")).alias("ssn"),
        F.lit("Male").alias("gender"),
        F.lit("1990-01-01").cast("date").alias("birth_date"),
        F.concat(F.lit("010"), (number * 7 % 5003).cast("string")).alias("phone"),
        F.concat(F.lit("MAIL"), (number * 3 % 4001 + person).cast("string"), F.lit("@ward.test")).alias("email"),
        F.col("amount").cast("decimal(10,2)").alias("salary"),
        F.lit("nurse").alias("type"),
        (number % 27).cast("int").alias("dept_id"),
        F.lit(None).cast("date").alias("start_job"),
        F.lit(None).cast("date").alias("end_job"),
        F.lit("Active").alias("status"),
    )


@registry.add(
    "employee_hire",
    with_roles(
        "ev emp dept",
        f"""asked AS (SELECT request_id, (request_ts, request_id) AS k, 's' || (request_id % 4000) AS s, '010' || (request_id * 7 % 5003) AS p,
                 'mail' || (request_id * 3 % 4001 + emp_id // 12) || '@ward.test' AS m, request_id % 27 AS dept_id FROM ev),
        flags AS (SELECT a.*, e.status AS status, ep.emp_id IS NOT NULL AS p_used, em.emp_id IS NOT NULL AS m_used, d.dept_id IS NULL AS no_dept
               FROM asked a LEFT JOIN emp e ON lower(e.ssn) = a.s LEFT JOIN emp ep ON ep.phone = a.p LEFT JOIN emp em ON em.email = a.m
               LEFT JOIN dept d ON d.dept_id = a.dept_id),
        open AS (SELECT * FROM flags WHERE status IS NULL AND NOT p_used AND NOT m_used AND NOT no_dept),
        {rounds_sql('open', ('s', 'p', 'm'))},
        made AS (SELECT k, row_number() OVER (ORDER BY k) + (SELECT max(emp_id) FROM emp) AS emp_id FROM won)
        SELECT f.request_id, i.emp_id IS NOT NULL AS accepted, coalesce(i.emp_id, -1) AS emp_id,
               CASE WHEN i.emp_id IS NOT NULL THEN 'Employee Added Successfully'
                    WHEN status = 'Inactive' THEN 'This Employee cannot be re-hired because he/she is inactive'
                    WHEN status = 'active' OR ws.k < f.k THEN 'This Employee is already working with us'
                    WHEN p_used OR wp.k < f.k THEN 'This phone number is already used by another employee'
                    WHEN m_used OR wm.k < f.k THEN 'This email address is already used by another employee'
                    ELSE 'This department does not exist' END AS message
        FROM flags f LEFT JOIN made i ON i.k = f.k LEFT JOIN won ws ON ws.s = f.s LEFT JOIN won wp ON wp.p = f.p LEFT JOIN won wm ON wm.m = f.m""",
        recursive=True,
    ),
)
def employee_hire(r: Roles) -> DataFrame:
    """Three rules at once, served in order; the tests compare it with a plain loop as well."""
    return staffing.hire(applicants(r), r.employee, r.department, moment(TODAY)).outcomes.withColumns(
        or_minus_one("emp_id")
    )


def employee_requests(r: Roles) -> DataFrame:
    number = F.col("request_id")
    return r.events.select(
        "request_id",
        "request_ts",
        batch_action(r).alias("action"),
        (F.col("emp_id") % 1800).alias("emp_id"),
        F.lit("New").alias("fname"),
        F.lit("Hire").alias("lname"),
        F.lit("Male").alias("gender"),
        F.lit("1990-01-01").cast("date").alias("birth_date"),
        F.concat(F.lit("s"), (number % 4000).cast("string")).alias("ssn"),
        F.concat(F.lit("010"), (number % 2003).cast("string")).alias("phone"),
        F.concat(F.lit("mail"), (number * 3 % 3001).cast("string"), F.lit("@WARD.test")).alias("email"),
        F.col("amount").alias("salary"),
        F.lit("nurse").alias("type"),
        (number % 27).cast("int").alias("dept_id"),
        F.lit(None).cast("date").alias("start_job"),
        F.lit(None).cast("date").alias("end_job"),
        F.when(number % 5 == 0, F.lit("Inactive")).alias("status"),
    )


def employee_sql(action: str) -> str:
    """SQL for employees, request after request; ``action`` as a column."""
    contact = """WHEN f.phones > 0 THEN 'This phone number is already used by another employee'
          WHEN f.emails > 0 THEN 'This email address is already used by another employee'"""
    no_dept = "WHEN q.no_dept THEN 'This department does not exist'"
    other = "(q.action = 'insert' OR x.id <> q.id)"
    fields = {"id": "BIGINT", "ssn": "VARCHAR", "phone": "VARCHAR", "email": "VARCHAR", "cents": "BIGINT", "type": "VARCHAR", "dept_id": "BIGINT", "status": "VARCHAR", "end_job": "VARCHAR"}
    return with_roles(
        "ev emp dept",
        replay_sql(
            "SELECT emp_id AS id, ssn, phone, email, cents, type, dept_id, status, NULL AS end_job FROM emp",
            fields,
            f"""SELECT a.*, d.dept_id IS NULL AS no_dept FROM (
                  SELECT request_id, request_ts, {action}, emp_id % 1800 AS id, 's' || (request_id % 4000) AS ssn, '010' || (request_id % 2003) AS phone,
                    'mail' || (request_id * 3 % 3001) || '@WARD.test' AS email, cents, request_id % 27 AS dept_id,
                    CASE WHEN request_id % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS status FROM ev) a
                LEFT JOIN dept d ON d.dept_id = a.dept_id""",
            {"id": "BIGINT", "ssn": "VARCHAR", "phone": "VARCHAR", "email": "VARCHAR", "cents": "BIGINT", "dept_id": "BIGINT", "status": "VARCHAR", "no_dept": "BOOLEAN"},
            {
                "same": "list_transform(list_filter(st, lambda x: lower(x.ssn) = lower(q.ssn)), lambda x: lower(x.status))",
                "phones": f"len(list_filter(st, lambda x: lower(x.phone) = lower(q.phone) AND {other}))",
                "emails": f"len(list_filter(st, lambda x: lower(x.email) = lower(q.email) AND {other}))",
            },
            f"""CASE q.action
              WHEN 'insert' THEN CASE WHEN list_contains(f.same, 'active') THEN 'This Employee is already working with us'
                WHEN list_contains(f.same, 'inactive') THEN 'This Employee cannot be re-hired because he/she is inactive' {contact} {no_dept} END
              WHEN 'update' THEN CASE WHEN me IS NULL THEN 'This employee does not exist' {no_dept} {contact} END
              ELSE CASE WHEN me IS NULL THEN 'This employee does not exist' WHEN lower(me.status) = 'inactive' THEN 'This employee is already inactive' END END""",
            {"ssn": "CASE WHEN q.action = 'insert' THEN q.ssn ELSE me.ssn END", "phone": "q.phone", "email": "q.email", "cents": "q.cents",
             "type": "'nurse'", "dept_id": "q.dept_id", "status": "q.status", "end_job": "NULL"},
            {"insert": "Employee Added Successfully", "update": "Employee Updated Successfully",
             "delete": "Employee deleted (status set to Inactive) successfully"},
            {"status": "'Inactive'", "end_job": "'2024-02-01'"},
        ),
    )


_EMPLOYEE_OUT = "\nSELECT request_id, coalesce(id, -1) AS emp_id, accepted, message FROM outcomes"
_EMPLOYEE_ROWS = f"""
    SELECT id AS emp_id, ssn, phone, email, {amount('cents')} AS salary, type, dept_id, status, coalesce(end_job, '') AS end_job FROM final"""


def employee_rows(result) -> DataFrame:
    end = F.coalesce(F.date_format("end_job", "yyyy-MM-dd"), F.lit("")).alias("end_job")
    return result.tables["employee"].select("emp_id", "ssn", "phone", "email", "salary", "type", "dept_id", "status", end)


def employee_batch(r: Roles):
    return staffing.employee_changes(employee_requests(r), r.employee, r.department, moment(TODAY))


@registry.add("employee_changes", employee_sql(BATCH_ACTION) + _EMPLOYEE_OUT)
def employee_changes(r: Roles) -> DataFrame:
    """People hired, changed and ended in one batch."""
    return employee_batch(r).outcomes.withColumns(or_minus_one("emp_id"))


@registry.add("employee_changes_table", employee_sql(BATCH_ACTION) + _EMPLOYEE_ROWS)
def employee_changes_table(r: Roles) -> DataFrame:
    return employee_rows(employee_batch(r))


def employee_updates(r: Roles):
    return staffing.update_employees(employee_requests(r).drop("action"), r.employee, r.department)


@registry.add("employee_update", employee_sql("'update' AS action") + _EMPLOYEE_OUT)
def employee_update(r: Roles) -> DataFrame:
    return employee_updates(r).outcomes


@registry.add("employee_update_table", employee_sql("'update' AS action") + _EMPLOYEE_ROWS)
def employee_update_table(r: Roles) -> DataFrame:
    return employee_rows(employee_updates(r))


TERMINATE = with_roles(
    "ev emp",
    """p AS (SELECT v.request_id, v.emp_id, e.emp_id IS NULL AS unknown, coalesce(e.status = 'Inactive', false) AS inactive,
            row_number() OVER (PARTITION BY v.emp_id ORDER BY v.request_ts, v.request_id) AS place
          FROM ev v LEFT JOIN emp e ON e.emp_id = v.emp_id)""",
)


@registry.add(
    "employee_terminate",
    TERMINATE
    + """
    SELECT request_id, emp_id, NOT unknown AND NOT inactive AND place = 1 AS accepted,
           CASE WHEN unknown THEN 'This employee does not exist' WHEN inactive OR place > 1 THEN 'This employee is already inactive'
                ELSE 'Employee deleted (status set to Inactive) successfully' END AS message FROM p""",
)
def employee_terminate(r: Roles) -> DataFrame:
    asked = r.events.select("request_id", "request_ts", "emp_id")
    return staffing.terminate(asked, r.employee, moment(TODAY)).outcomes


@registry.add(
    "employee_terminate_table",
    TERMINATE
    + """
    SELECT e.emp_id, CASE WHEN t.emp_id IS NULL THEN e.status ELSE 'Inactive' END AS status,
           CASE WHEN t.emp_id IS NOT NULL THEN '2024-02-01' END AS end_job
    FROM emp e LEFT JOIN (SELECT emp_id FROM p WHERE NOT unknown AND NOT inactive AND place = 1) t ON t.emp_id = e.emp_id""",
)
def employee_terminate_table(r: Roles) -> DataFrame:
    asked = r.events.select("request_id", "request_ts", "emp_id")
    return staffing.terminate(asked, r.employee, moment(TODAY)).tables["employee"].select("emp_id", "status", "end_job")
