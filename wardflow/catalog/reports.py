"""Reporting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, clock, day
from wardflow.functions.clock import moment, month_key
from wardflow.functions.money import money
from wardflow.operators.scan import number_rows, spread_dates
from wardflow.operators.snapshots import set_by_keys
from wardflow.plans import reports
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


@registry.add(
    "patient_basic_info",
    with_roles("pat", "SELECT p_id, fname || ' ' || lname AS full_name, email, phone, ssn FROM pat"),
)
def patient_basic_info(r: Roles) -> DataFrame:
    return reports.patient_basic_info(r.patient).select("p_id", "full_name", "email", "phone", "ssn")


@registry.add(
    "doctor_schedule",
    with_roles(
        "weekly dept",
        """SELECT w.id AS doctor_appointment_id, e.emp_id AS doctor_id, e.fname || ' ' || e.lname AS doctor_name, w.day,
                  w.shift_start, w.shift_end, w.examination_price, d.dept_id, d.dept_name
           FROM weekly w JOIN emp e ON w.emp_id = e.emp_id JOIN dept d ON w.dept_id = d.dept_id""",
    ),
)
def doctor_schedule(r: Roles) -> DataFrame:
    return reports.doctor_schedule(r.weekly, r.employee, r.department)


def suppliers(r: Roles) -> DataFrame:
    """Suppliers as employees: names only."""
    return r.table("supplier").select(
        F.col("s_suppkey").alias("emp_id"), F.col("s_name").alias("fname"), F.lit("MD").alias("lname")
    )


@registry.add(
    "reservations_full",
    with_roles(
        "pat dept",
        f"""staff AS (SELECT s_suppkey AS emp_id, s_name || ' MD' AS full_name FROM supplier)
        SELECT l.l_orderkey * 8 + l.l_linenumber AS reservation_id, {clock('l.l_shipdate')} AS date_time,
               p.fname || ' ' || p.lname AS patient_name, d.full_name AS doctor_name,
               rec.full_name AS receptionist_name, dept.dept_name,
               CAST(l.l_extendedprice AS DOUBLE) AS paid_money
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN pat p ON o.o_custkey = p.p_id
        JOIN staff d ON l.l_suppkey = d.emp_id
        JOIN staff rec ON rec.emp_id = CASE WHEN l.l_returnflag <> 'R' THEN l.l_suppkey + 1 END
        JOIN dept ON dept.dept_id = l.l_partkey % 25""",
    ),
)
def reservations_full(r: Roles) -> DataFrame:
    lines = r.table("lineitem").join(
        r.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("p_id")), "l_orderkey"
    )
    reservation = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("reservation_id"),
        F.col("l_shipdate").alias("date_time"),
        "p_id",
        F.col("l_suppkey").alias("doctor_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") + 1).alias("receptionist_id"),
        (F.col("l_partkey") % 25).alias("dept_id"),
        money("l_extendedprice", 12).alias("paid_money"),
    )
    return reports.reservations_full(reservation, r.patient, suppliers(r), r.department)


@registry.add(
    "invoices_full",
    with_roles(
        "inv det pat emp",
        f"""SELECT i.invoice_id, d.reservation_id, d.reservation_type, {day('i.date')} AS date, i.payment_method,
               {amount('i.cents')} AS paid_money, p.fname || ' ' || p.lname AS patient_name,
               e.fname || ' ' || e.lname AS employee_name
        FROM inv i JOIN det d ON d.invoice_id = i.invoice_id JOIN pat p ON i.p_id = p.p_id
        JOIN emp e ON i.emp_id = e.emp_id""",
    ),
)
def invoices_full(r: Roles) -> DataFrame:
    return reports.invoices_full(r.invoice, r.invoice_details, r.patient, r.employee)


@registry.add(
    "revenue_by_department",
    with_roles(
        "inv emp dept",
        f"""SELECT d.dept_name, {amount('sum(i.cents)')} AS total_revenue
        FROM inv i JOIN emp e ON i.emp_id = e.emp_id JOIN dept d ON e.dept_id = d.dept_id GROUP BY d.dept_name""",
    ),
)
def revenue_by_department(r: Roles) -> DataFrame:
    return reports.revenue_by_department(r.invoice, r.employee, r.department)


@registry.add(
    "top_doctors",
    with_roles(
        "inv det emp dept resv",
        f"""billed AS (SELECT DISTINCT reservation_id, invoice_id FROM det WHERE reservation_type = 'Clinic')
        SELECT e.emp_id, e.fname || ' ' || e.lname AS doctor_name, d.dept_name,
               count(r.reservation_id) AS total_appointments, {amount('sum(i.cents)')} AS total_revenue
        FROM emp e JOIN dept d ON e.dept_id = d.dept_id JOIN resv r ON e.emp_id = r.doctor_id
        JOIN billed b ON b.reservation_id = r.reservation_id JOIN inv i ON i.invoice_id = b.invoice_id
        WHERE lower(e.type) = 'doctor'
        GROUP BY e.emp_id, e.fname, e.lname, d.dept_name ORDER BY total_appointments DESC, e.emp_id LIMIT 5""",
    ),
)
def top_doctors(r: Roles) -> DataFrame:
    return reports.top_doctors(r.employee, r.department, r.reservation, r.invoice, r.invoice_details)


@registry.add(
    "monthly_new_patients",
    with_roles(
        "resv",
        """SELECT strftime(date_time, '%Y-%m') AS month, count(DISTINCT p_id) AS new_patients
        FROM resv GROUP BY 1 ORDER BY new_patients DESC, month LIMIT 5""",
    ),
)
def monthly_new_patients(r: Roles) -> DataFrame:
    return reports.monthly_new_patients(r.reservation)


@registry.add(
    "monthly_patient_sketches",
    with_roles(
        "resv",
        """SELECT strftime(date_time, '%Y-%m') AS month, count(DISTINCT p_id) AS new_patients, TRUE AS within_error
        FROM resv GROUP BY 1""",
    ),
)
def monthly_patient_sketches(r: Roles) -> DataFrame:
    """Sketches of two deliveries merged, held against the exact counts: four standard errors, or one patient."""
    first = F.col("reservation_id") % 2 == 0
    halves = [reports.patient_month_sketches(r.reservation.where(half)) for half in (first, ~first)]
    estimate = reports.monthly_new_patients_estimate(reports.merge_month_sketches(*halves), n=None)
    exact = r.reservation.groupBy(month_key("date_time").alias("month")).agg(F.countDistinct("p_id").alias("exact"))
    error = F.greatest(F.lit(1.0), F.col("exact") * (4 * 1.04 / 2 ** (reports.SKETCH_LG_K / 2)))
    return exact.join(estimate, "month", "left").select(
        "month",
        F.col("exact").alias("new_patients"),
        F.coalesce(F.abs(F.col("new_patients") - F.col("exact")) <= error, F.lit(False)).alias("within_error"),
    )


EXPIRY_AS_OF = "1998-11-30 08:00:00"


@registry.add(
    "expiry_alert",
    f"""SELECT l_partkey AS drug_id, l_returnflag AS drug_name, CAST(l_quantity AS BIGINT) AS quantity,
               {day('l_shipdate')} AS exp_date,
               datediff('day', TIMESTAMP '{EXPIRY_AS_OF}', l_shipdate) AS days_to_expire
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '{EXPIRY_AS_OF}'
          AND l_shipdate <= TIMESTAMP '{EXPIRY_AS_OF}' + INTERVAL 3 MONTH""",
)
def expiry_alert(r: Roles) -> DataFrame:
    drugs = r.table("lineitem").select(
        F.col("l_partkey").alias("drug_id"),
        F.col("l_returnflag").alias("drug_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("exp_date"),
    )
    return reports.expiry_alert(drugs, moment(EXPIRY_AS_OF))


@registry.add(
    "invoice_line_totals",
    with_roles(
        "det",
        f"""SELECT invoice_id, process_id, CAST(quantity AS BIGINT) AS quantity,
                   {amount('cents * quantity')} AS total FROM det""",
    ),
)
def invoice_line_totals(r: Roles) -> DataFrame:
    return reports.invoice_line_totals(r.invoice_details).select("invoice_id", "process_id", "quantity", "total")


@registry.add(
    "service_name_union",
    "SELECT p_name AS service_name FROM part UNION SELECT n_name FROM nation",
)
def service_name_union(r: Roles) -> DataFrame:
    tests = r.table("part").select(F.col("p_name").alias("test_name"))
    scans = r.table("nation").select(F.col("n_name").alias("rad_name"))
    return reports.service_names(tests, scans)


@registry.add(
    "reward_deduction_staging",
    with_roles(
        "rew ded",
        f"""SELECT emp_id, 'Reward' AS rd_type, {amount('cents')} AS amount, {day('date')} AS rd_date FROM rew
        UNION ALL SELECT emp_id, 'Deduction', {amount('cents')}, {day('date')} FROM ded""",
    ),
)
def reward_deduction_staging(r: Roles) -> DataFrame:
    return reports.reward_deduction_staging(r.reward, r.deduction)


@registry.add(
    "spread_start_dates",
    with_roles(
        "emp",
        f"""SELECT emp_id, {day("DATE '2025-12-01' - CAST((row_number() OVER (ORDER BY emp_id) - 1) % 10 AS INTEGER)")}
                AS start_job FROM emp""",
    ),
)
def spread_start_dates(r: Roles) -> DataFrame:
    staff = r.employee.select("emp_id", "start_job")
    return spread_dates(staff, ["emp_id"], moment("2025-12-01 00:00:00"), "start_job")


@registry.add(
    "numbered_reservations",
    with_roles(
        "resv",
        """SELECT reservation_id, doctor_id,
                  row_number() OVER (PARTITION BY doctor_id ORDER BY date_time, reservation_id) AS place
           FROM resv""",
    ),
)
def numbered_reservations(r: Roles) -> DataFrame:
    rows = r.reservation.select("reservation_id", "doctor_id", "date_time")
    return number_rows(rows, ["date_time", "reservation_id"], "place", keys=["doctor_id"]).drop("date_time")


@registry.add(
    "examination_prices",
    with_roles(
        "weekly",
        """SELECT id, dept_id, CASE WHEN dept_id IN (8, 9) THEN 1000 WHEN dept_id IN (2, 3, 5, 6) THEN 500
                  WHEN dept_id IN (1, 4, 7) THEN 800 ELSE examination_price END AS examination_price
           FROM weekly""",
    ),
)
def examination_prices(r: Roles) -> DataFrame:
    # Price per group of departments.
    prices = {(8, 9): 1000, (2, 3, 5, 6): 500, (1, 4, 7): 800}
    slots = r.weekly.select("id", "dept_id", "examination_price")
    return set_by_keys(slots, "examination_price", "dept_id", prices)
