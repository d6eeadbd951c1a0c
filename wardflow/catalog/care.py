"""Patients, bookings, diagnoses, prescriptions, laboratory and radiology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import amount, amount_text, clock, day, or_minus_one, Registry
from wardflow.catalog.people import BATCH_ACTION, batch_action, catalogue_sql
from wardflow.functions.clock import at_time, moment, seconds_of_day
from wardflow.plans import clinic, diagnostics, duty
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

# ------------------------------------------------------------------- on duty


def department_events(r: Roles) -> DataFrame:
    """Events as calls for a department."""
    return r.events.select(
        "request_id",
        "request_ts",
        F.col("emp_id").alias("p_id"),
        (F.col("request_id") % 27).cast("int").alias("dept_id"),
        F.col("event_type").alias("payment_method"),
    )


_CALLS = """asked AS (SELECT request_id, request_ts, emp_id AS p_id, request_id % 27 AS dept_id, event_type AS payment_method,
           CAST(request_ts AS DATE) AS d, dayname(request_ts) AS wd,
           hour(request_ts) * 3600 + minute(request_ts) * 60 + second(request_ts) AS t FROM ev)"""
_PLAIN = "a.t BETWEEN {s} AND {e}"
_WRAP = "(({s} < {e} AND a.t BETWEEN {s} AND {e}) OR ({s} > {e} AND (a.t >= {s} OR a.t <= {e})))"


def _doctor_sql(test: str) -> str:
    return with_roles(
        "ev weekly",
        f"""{_CALLS}
        SELECT a.request_id, coalesce(min(w.emp_id), -1) AS doctor_id
        FROM asked a LEFT JOIN weekly w ON w.dept_id = a.dept_id AND w.day = a.wd AND {test.format(s='w.shift_start', e='w.shift_end')}
        GROUP BY a.request_id""",
    )


@registry.add("on_duty_plain", _doctor_sql(_PLAIN))
def on_duty_plain(r: Roles) -> DataFrame:
    found = duty.with_doctor(department_events(r), r.weekly)
    return found.select("request_id", F.coalesce("duty_doctor.emp_id", F.lit(-1)).alias("doctor_id"))


@registry.add("on_duty_wrap", _doctor_sql(_WRAP))
def on_duty_wrap(r: Roles) -> DataFrame:
    found = duty.with_doctor(department_events(r), r.weekly, wrap=True)
    return found.select("request_id", F.coalesce("duty_doctor.emp_id", F.lit(-1)).alias("doctor_id"))


@registry.add(
    "duty_roster",
    with_roles(
        "weekly",
        """SELECT id, emp_id, dept_id FROM weekly WHERE day = 'Monday'
           AND ((shift_start < shift_end AND 66600 BETWEEN shift_start AND shift_end)
             OR (shift_start > shift_end AND (66600 >= shift_start OR 66600 <= shift_end)))""",
    ),
)
def duty_roster(r: Roles) -> DataFrame:
    return duty.duty_roster(r.weekly, moment("2024-01-08 18:30:00"), wrap=True).select("id", "emp_id", "dept_id")


# ------------------------------------------------------------------ patients


def visitors(r: Roles) -> DataFrame:
    """Events as people at the desk; every tenth customer number occurs, known or not."""
    number = (F.col("emp_id") / 12 * 11).cast("long").cast("string")
    return r.events.select(
        "request_id",
        "request_ts",
        F.lit("Walk").alias("fname"),
        F.lit("In").alias("lname"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("new"), F.col("request_id").cast("string"))).alias("email"),
        F.lit("1990-01-01").cast("date").alias("birth_date"),
        F.lit("Male").alias("gender"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("020"), F.col("request_id").cast("string"))).alias("phone"),
        F.concat(F.lit("s"), number).alias("ssn"),
    )


_VISITORS = """asked AS (SELECT request_id, request_ts, 's' || (emp_id // 12 * 11) AS ssn,
           CASE WHEN event_type <> 'view' THEN 'new' || request_id END AS email,
           CASE WHEN event_type <> 'click' THEN '020' || request_id END AS phone FROM ev)"""
GET_OR_ADD = with_roles(
    "ev pat",
    f"""{_VISITORS},
    t AS (SELECT a.*, p.p_id AS old FROM asked a LEFT JOIN pat p ON lower(p.ssn) = lower(a.ssn)),
    w AS (SELECT *, row_number() OVER (PARTITION BY ssn ORDER BY request_ts, request_id) AS place FROM t WHERE old IS NULL),
    n AS (SELECT *, (SELECT max(p_id) FROM pat) + row_number() OVER (ORDER BY request_ts, request_id) AS p_id FROM w WHERE place = 1)""",
)


@registry.add(
    "patient_get_or_add",
    GET_OR_ADD
    + """
    SELECT t.request_id, w.place = 1 IS TRUE AS accepted,
           CASE WHEN w.place = 1 THEN 'Patient inserted successfully.' ELSE 'Patient already exists. Returned existing p_id.' END AS message,
           coalesce(t.old, n.p_id) AS p_id
    FROM t LEFT JOIN w ON w.request_id = t.request_id LEFT JOIN n ON n.ssn = t.ssn""".replace(
        "w.place = 1 IS TRUE", "coalesce(w.place = 1, false)"
    ),
)
def patient_get_or_add(r: Roles) -> DataFrame:
    return clinic.get_or_add_patients(visitors(r), r.patient).outcomes


@registry.add(
    "patient_table_after_add",
    GET_OR_ADD + "\nSELECT p_id, lower(ssn) AS ssn, phone FROM pat UNION ALL SELECT p_id, lower(ssn), phone FROM n",
)
def patient_table_after_add(r: Roles) -> DataFrame:
    added = clinic.get_or_add_patients(visitors(r), r.patient).tables["patient"]
    return added.select("p_id", F.lower("ssn").alias("ssn"), "phone")


CONTACT = with_roles("ev pat", f"{_VISITORS}")


@registry.add(
    "patient_contact_update",
    CONTACT
    + """
    SELECT a.request_id, p.p_id IS NOT NULL AS accepted,
           CASE WHEN p.p_id IS NULL THEN 'Patient with provided SSN not found.' ELSE 'Patient email and phone updated successfully.' END AS message
    FROM asked a LEFT JOIN pat p ON lower(p.ssn) = lower(a.ssn)""",
)
def patient_contact_update(r: Roles) -> DataFrame:
    asked = visitors(r).select("request_id", "request_ts", "ssn", "email", "phone")
    return clinic.update_patient_contact(asked, r.patient).outcomes


@registry.add(
    "patient_contact_table",
    CONTACT
    + """
    SELECT p.p_id, coalesce(l.email, p.email) AS email, coalesce(l.phone, p.phone) AS phone
    FROM pat p LEFT JOIN (
      SELECT lower(ssn) AS ssn, arg_max(email, (request_ts, request_id)) FILTER (WHERE email IS NOT NULL) AS email,
             arg_max(phone, (request_ts, request_id)) FILTER (WHERE phone IS NOT NULL) AS phone
      FROM asked GROUP BY 1) l ON l.ssn = lower(p.ssn)""",
)
def patient_contact_table(r: Roles) -> DataFrame:
    asked = visitors(r).select("request_id", "request_ts", "ssn", "email", "phone")
    return clinic.update_patient_contact(asked, r.patient).tables["patient"].select("p_id", "email", "phone")


# ------------------------------------------------------------------ bookings


def stored_bookings(r: Roles) -> DataFrame:
    """Clicks as reservations already on file."""
    return r.events.filter("event_type = 'click'").select(
        F.col("request_id").alias("reservation_id"),
        F.col("request_ts").alias("date_time"),
        F.col("emp_id").alias("p_id"),
        (F.col("emp_id") / 12 * 2).cast("long").alias("doctor_id"),
    )


# All calls on one day, so that doctors reach their limit.
_CROWDED_CALLS = _CALLS.replace(" FROM ev)", " FROM crowd)")
_CROWD = """crowd AS (SELECT * REPLACE ((SELECT max(date) FROM dated) + (date_trunc('second', request_ts) - date_trunc('day', request_ts)) AS request_ts) FROM ev),
    """


def booking_sql(calls: str) -> str:
    return with_roles(
        "ev weekly emp_shift dated",
        f"""{calls},
    stored AS (SELECT emp_id // 12 * 2 AS doctor_id, CAST(request_ts AS DATE) AS d, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
    docs AS (SELECT a.request_id, min((w.emp_id, w.examination_price)) AS pick
             FROM asked a JOIN weekly w ON w.dept_id = a.dept_id AND w.day = a.wd AND a.t BETWEEN w.shift_start AND w.shift_end GROUP BY 1),
    recs AS (SELECT a.request_id, min(e.emp_id) AS rec FROM asked a JOIN dated s ON s.date = a.d AND a.t BETWEEN s.start_time AND s.end_time
             JOIN emp_shift x ON x.shift_id = s.shift_id JOIN emp e ON e.emp_id = x.emp_id AND e.type = 'Receptionist' GROUP BY 1),
    t AS (SELECT a.*, d.pick[1] AS doctor_id, d.pick[2] AS price, r.rec,
                 CASE WHEN a.dept_id NOT IN (SELECT dept_id FROM weekly) THEN '❌ This department has no registered doctors.'
                      WHEN d.request_id IS NULL THEN '❌ No doctors available now for this department.'
                      WHEN r.rec IS NULL THEN '❌ No receptionist available now.' END AS refused
          FROM asked a LEFT JOIN docs d ON d.request_id = a.request_id LEFT JOIN recs r ON r.request_id = a.request_id),
    line AS (SELECT *, row_number() OVER (PARTITION BY doctor_id, d ORDER BY request_ts, request_id) AS place FROM t WHERE refused IS NULL),
    won AS (SELECT l.*, row_number() OVER (ORDER BY l.request_ts, l.request_id) AS k FROM line l LEFT JOIN stored s ON s.doctor_id = l.doctor_id AND s.d = l.d
            WHERE place <= 20 - coalesce(s.n, 0)),
    made AS (SELECT *, k + (SELECT max(request_id) FROM ev WHERE event_type = 'click') AS reservation_id,
                    k + (SELECT max(o_orderkey) FROM orders) AS invoice_id FROM won)""",
    )


BOOKING, CROWDED_BOOKING = booking_sql(_CALLS), booking_sql(_CROWD + _CROWDED_CALLS)


def bookings(r: Roles, crowded: bool = False):
    """Events as requests, with the usual daily limit of 20 a doctor; ``crowded``: all on the last day of the schedule."""
    calls = department_events(r)
    if crowded:
        latest = r.dated.agg(F.max("date")).scalar()
        calls = calls.withColumn("request_ts", at_time(latest, seconds_of_day("request_ts")))
    return clinic.book_doctor(
        calls, r.weekly, r.employee, r.emp_shift, r.dated, stored_bookings(r), r.invoice
    )


_BOOKED = """
    SELECT t.request_id, m.k IS NOT NULL AS accepted, coalesce(m.reservation_id, -1) AS reservation_id, coalesce(m.invoice_id, -1) AS invoice_id,
           CASE WHEN m.k IS NOT NULL THEN '✔ Reservation completed successfully. Reservation ID = ' || m.reservation_id || ', Assigned Doctor ID = ' || m.doctor_id
                WHEN refused_t IS NOT NULL THEN refused_t ELSE '❌ Maximum daily reservations reached for this doctor.' END AS message
    FROM (SELECT request_id, refused AS refused_t FROM t) t LEFT JOIN made m ON m.request_id = t.request_id"""


@registry.add("book_doctor_limit", CROWDED_BOOKING + _BOOKED)
def book_doctor_limit(r: Roles) -> DataFrame:
    """Calls of one day: most doctors reach their limit."""
    return bookings(r, crowded=True).outcomes.withColumns(or_minus_one("reservation_id", "invoice_id"))


@registry.add("book_doctor", BOOKING + _BOOKED)
def book_doctor(r: Roles) -> DataFrame:
    return bookings(r).outcomes.withColumns(or_minus_one("reservation_id", "invoice_id"))


@registry.add(
    "book_doctor_lines",
    BOOKING
    + """
    SELECT invoice_id, reservation_id, 'Clinic' AS reservation_type, doctor_id AS process_id, CAST(price AS DOUBLE) AS unit_price,
           1 AS quantity, CAST(price AS DOUBLE) AS total, dept_id FROM made""",
)
def book_doctor_lines(r: Roles) -> DataFrame:
    return bookings(r).tables["invoice_details"]


@registry.add(
    "book_doctor_reservations",
    BOOKING
    + f"""
    SELECT reservation_id, {clock('request_ts')} AS date_time, CAST(price AS DOUBLE) AS paid_money, p_id, dept_id, doctor_id, rec AS receptionist_id FROM made""",
)
def book_doctor_reservations(r: Roles) -> DataFrame:
    return bookings(r).tables["reservations"]


@registry.add(
    "book_doctor_invoices",
    BOOKING
    + f"""
    SELECT invoice_id, {day('request_ts')} AS date, payment_method, CAST(price AS DOUBLE) AS paid_money, p_id, rec AS emp_id FROM made""",
)
def book_doctor_invoices(r: Roles) -> DataFrame:
    return bookings(r).tables["invoice"]


@registry.add(
    "add_diagnosis",
    with_roles(
        "ev resv",
        """asked AS (SELECT request_id, request_ts, request_id * 3 AS reservation_id FROM ev),
        f AS (SELECT a.*, r.p_id, r.doctor_id FROM asked a LEFT JOIN resv r ON r.reservation_id = a.reservation_id),
        n AS (SELECT request_id, (SELECT max(l_linenumber) FROM lineitem) + row_number() OVER (ORDER BY request_ts, request_id) AS dig_id FROM f WHERE p_id IS NOT NULL)
        SELECT f.request_id, n.dig_id IS NOT NULL AS accepted, coalesce(n.dig_id, -1) AS dig_id,
               CASE WHEN n.dig_id IS NULL THEN 'Invalid reservation_id.' ELSE 'Diagnosis inserted successfully.' END AS message
        FROM f LEFT JOIN n ON n.request_id = f.request_id""",
    ),
)
def add_diagnosis(r: Roles) -> DataFrame:
    asked = r.events.select(
        "request_id",
        "request_ts",
        (F.col("request_id") * 3).alias("reservation_id"),
        F.col("event_type").alias("dig_description"),
    )
    history = r.table("lineitem").select(F.col("l_linenumber").alias("dig_id"))
    return clinic.add_diagnoses(asked, r.reservation, history).outcomes.withColumns(or_minus_one("dig_id"))


@registry.add(
    "add_prescription",
    with_roles(
        "ev resv",
        """asked AS (SELECT request_id, request_ts, emp_id * 13 AS reservation_id FROM ev),
        done AS (SELECT o_orderkey AS reservation_id FROM orders WHERE o_orderstatus = 'F'),
        f AS (SELECT a.*, CASE WHEN r.p_id IS NULL THEN 'Invalid reservation id.'
                 WHEN d.reservation_id IS NOT NULL THEN ' This reservation already have a prescription ' END AS refused
              FROM asked a LEFT JOIN resv r ON r.reservation_id = a.reservation_id LEFT JOIN done d ON d.reservation_id = a.reservation_id),
        w AS (SELECT reservation_id, min((request_ts, request_id)) AS k FROM f WHERE refused IS NULL GROUP BY 1),
        n AS (SELECT k[2] AS request_id, (SELECT max(reservation_id) FROM done) + row_number() OVER (ORDER BY k) AS prescription_id FROM w)
        SELECT f.request_id, n.request_id IS NOT NULL AS accepted, coalesce(n.prescription_id, -1) AS prescription_id,
               CASE WHEN n.request_id IS NOT NULL THEN 'Prescription added successfully. Prescription ID = ' || n.prescription_id
                    ELSE coalesce(refused, ' This reservation already have a prescription ') END AS message
        FROM f LEFT JOIN n ON n.request_id = f.request_id""",
    ),
)
def add_prescription(r: Roles) -> DataFrame:
    asked = r.events.select(
        "request_id",
        "request_ts",
        (F.col("emp_id") * 13).alias("reservation_id"),
        F.lit("twice a day").alias("notes"),
        F.col("event_type").alias("drug_name"),
    )
    done = r.table("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("prescription_id"), F.col("o_orderkey").alias("reservation_id")
    )
    return clinic.add_prescriptions(asked, r.reservation, done).outcomes.withColumns(or_minus_one("prescription_id"))


# ------------------------------------------------- laboratory and radiology


def exam_requests(r: Roles, key: str, name: str) -> DataFrame:
    """Every event adds, changes or deletes an examination."""
    kind = F.lower("action")
    number = (F.col("emp_id") / 12).cast("int")
    return r.events.withColumn("action", batch_action(r)).select(
        "request_id",
        "request_ts",
        "action",
        F.when(kind != "insert", F.col("request_id") * 7 % 2500).alias(key),
        F.when(kind == "insert", F.concat(F.lit("exam "), (number * 29).cast("string")))
        .when((kind == "update") & (F.col("amount") > 3), F.concat(F.lit("Exam "), (number * 17).cast("string")))
        .alias(name),
        (F.col("request_id") % 48).cast("int").alias("delivery_duration"),
        (F.col("amount") - 1).cast("decimal(10,2)").alias("price"),
    )


_EXAM_STATE = "SELECT p_partkey AS id, 'Exam ' || p_partkey AS name FROM part"
_EXAM_ASKED = f"""SELECT request_id, request_ts, action, CASE WHEN action <> 'insert' THEN request_id * 7 % 2500 END AS id,
     CASE WHEN action = 'insert' THEN 'exam ' || (emp_id // 12 * 29) WHEN action = 'update' AND cents > 300 THEN 'Exam ' || (emp_id // 12 * 17) END AS name,
     cents - 100 AS price, false AS used
     FROM (SELECT *, {BATCH_ACTION} FROM ev)"""


def exam_sql(messages) -> str:
    return with_roles("ev", catalogue_sql(_EXAM_STATE, _EXAM_ASKED, messages, price_rule=True))


def exam_state(r: Roles, key: str, name: str) -> DataFrame:
    return r.exams.withColumnsRenamed({"item_id": key, "name": name})


def lab_batch(r: Roles):
    return diagnostics.lab_test_changes(exam_requests(r, "test_id", "test_name"), exam_state(r, "test_id", "test_name"))


def radiology_batch(r: Roles):
    return diagnostics.radiology_changes(exam_requests(r, "rad_id", "rad_name"), exam_state(r, "rad_id", "rad_name"))


@registry.add(
    "lab_test_changes",
    exam_sql(diagnostics.LAB_TEXTS) + "\nSELECT request_id, accepted, message, coalesce(id, -1) AS test_id FROM outcomes",
)
def lab_test_changes(r: Roles) -> DataFrame:
    return lab_batch(r).outcomes.withColumns(or_minus_one("test_id"))


@registry.add(
    "lab_test_table",
    exam_sql(diagnostics.LAB_TEXTS) + "\nSELECT id AS test_id, name AS test_name FROM final",
)
def lab_test_table(r: Roles) -> DataFrame:
    return lab_batch(r).tables["lab_tests"].select("test_id", "test_name")


@registry.add(
    "radiology_changes",
    exam_sql(diagnostics.RADIOLOGY_TEXTS) + "\nSELECT request_id, accepted, message, coalesce(id, -1) AS rad_id FROM outcomes",
)
def radiology_changes(r: Roles) -> DataFrame:
    return radiology_batch(r).outcomes.withColumns(or_minus_one("rad_id"))


@registry.add(
    "radiology_table",
    exam_sql(diagnostics.RADIOLOGY_TEXTS) + "\nSELECT id AS rad_id, name AS rad_name FROM final",
)
def radiology_table(r: Roles) -> DataFrame:
    return radiology_batch(r).tables["radiology"].select("rad_id", "rad_name")


def lab_orders(r: Roles) -> DataFrame:
    """Orders as lab requests; those with order status F state an amount of their own."""
    return r.orders.select(
        "request_id",
        "request_ts",
        "p_id",
        "payment_method",
        F.when(F.col("order_status") == "F", F.col("paid").cast("decimal(10,2)")).alias("paid_money"),
    )


_TIME = "hour(a.request_ts) * 3600 + minute(a.request_ts) * 60 + second(a.request_ts)"
LAB = with_roles(
    "ord exams exam_lines weekly emp_shift order_shifts",
    f"""priced AS (SELECT l.request_id, l.name, e.item_id, e.cents FROM exam_lines l LEFT JOIN exams e ON lower(e.name) = lower(l.name)),
    tot AS (SELECT request_id, count(*) AS n, count(item_id) AS known, sum(cents) AS cents, count(DISTINCT name) AS names FROM priced GROUP BY 1),
    rec AS (SELECT DISTINCT s.start_time, s.end_time, min(e.emp_id) AS emp_id FROM order_shifts s JOIN emp_shift x ON x.shift_id = s.shift_id
            JOIN emp e ON e.emp_id = x.emp_id AND e.type = 'Receptionist' GROUP BY ALL),
    t AS (SELECT a.request_id, a.request_ts, a.p_id, tot.cents, CASE WHEN tot.known < tot.n THEN 'One or more tests do not exist.'
              WHEN tot.n IS NULL THEN 'The order has no tests.' WHEN tot.names < tot.n THEN 'A test is listed more than once.'
              WHEN a.order_status = 'F' AND a.cents <> tot.cents THEN 'Incorrect paid amount. Total required = ' || {amount_text('CAST(tot.cents AS BIGINT)')} END AS refused,
              (SELECT min(emp_id) FROM rec WHERE {_TIME} BETWEEN start_time AND end_time) AS receptionist
          FROM ord a LEFT JOIN tot ON tot.request_id = a.request_id),
    made AS (SELECT *, row_number() OVER (ORDER BY request_ts, request_id) AS k FROM t WHERE refused IS NULL),
    ids AS (SELECT *, k + (SELECT max(l_orderkey) FROM lineitem) AS reservation_id, k + (SELECT max(o_orderkey) FROM orders) AS invoice_id FROM made)""",
)


def lab(r: Roles):
    stored = r.table("lineitem").select(F.col("l_orderkey").alias("reservation_id"))
    return diagnostics.book_lab(
        lab_orders(r),
        r.exam_lines,
        exam_state(r, "test_id", "test_name"),
        r.employee,
        r.weekly,
        r.emp_shift,
        r.order_shifts,
        stored,
        r.invoice,
    )


@registry.add(
    "book_lab",
    LAB
    + """
    SELECT t.request_id, i.k IS NOT NULL AS accepted, coalesce(i.reservation_id, -1) AS reservation_id, coalesce(i.invoice_id, -1) AS invoice_id,
           coalesce(t.refused, 'Lab reservation added successfully. Reservation ID = ' || i.reservation_id) AS message
    FROM t LEFT JOIN ids i ON i.request_id = t.request_id""",
)
def book_lab(r: Roles) -> DataFrame:
    return lab(r).outcomes.withColumns(or_minus_one("reservation_id", "invoice_id"))


@registry.add(
    "book_lab_reservations",
    LAB
    + f"""
    SELECT i.reservation_id, {day('i.request_ts')} AS date, {amount('i.cents')} AS paid_money, i.p_id,
           (SELECT min(emp_id) FROM emp WHERE dept_id = 13) AS doctor_id,
           (SELECT string_agg(name, ' , ' ORDER BY name) FROM priced p WHERE p.request_id = i.request_id) AS test_name,
           CAST(i.receptionist AS VARCHAR) AS receptionist_id
    FROM ids i""",
)
def book_lab_reservations(r: Roles) -> DataFrame:
    return lab(r).tables["lab_reservation"]


@registry.add(
    "book_lab_lines",
    LAB
    + f"""
    SELECT i.invoice_id, i.reservation_id, 'lab' AS reservation_type, p.item_id AS process_id, {amount('p.cents')} AS unit_price,
           1 AS quantity, {amount('p.cents')} AS total, 13 AS dept_id
    FROM ids i JOIN priced p ON p.request_id = i.request_id""",
)
def book_lab_lines(r: Roles) -> DataFrame:
    return lab(r).tables["invoice_details"]


RADIOLOGY = with_roles(
    "ord exams exam_lines weekly emp_shift order_shifts pat",
    f"""asked AS (SELECT request_id, date_trunc('week', request_ts) + (request_ts - date_trunc('day', request_ts)) AS request_ts, p_id % 40 AS p_id FROM ord),
    lines AS (SELECT request_id, CASE WHEN name LIKE 'EXAM%' THEN 'EXAM ' || (CAST(substr(name, 6) AS INTEGER) % 12) ELSE name END AS name FROM exam_lines),
    priced AS (SELECT l.request_id, l.name, e.item_id, e.cents FROM lines l LEFT JOIN exams e ON lower(e.name) = lower(l.name)),
    tot AS (SELECT request_id, count(*) AS n, count(item_id) AS known, sum(cents) AS cents, count(DISTINCT name) AS names FROM priced GROUP BY 1),
    rec AS (SELECT s.start_time AS b, s.end_time AS e, min(m.emp_id) AS emp_id FROM order_shifts s JOIN emp_shift x ON x.shift_id = s.shift_id
            JOIN emp m ON m.emp_id = x.emp_id AND m.type = 'Receptionist' GROUP BY ALL),
    stored AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, o_custkey % 40 AS p_id, 'exam ' || (o_orderkey % 12) AS name FROM orders WHERE o_orderpriority = '1-URGENT'),
    booked AS (SELECT DISTINCT a.request_id FROM asked a JOIN priced p ON p.request_id = a.request_id
               JOIN stored s ON s.p_id = a.p_id AND s.d = CAST(a.request_ts AS DATE) AND s.name = lower(p.name)),
    t AS (SELECT a.*, tot.n, tot.cents, CASE WHEN a.p_id NOT IN (SELECT p_id FROM pat) THEN 'Invalid patient ID.'
              WHEN NOT EXISTS (SELECT 1 FROM rec WHERE (b < e AND {_TIME} BETWEEN b AND e) OR (b > e AND ({_TIME} >= b OR {_TIME} <= e)))
                THEN 'No receptionist available in the current shift.'
              WHEN tot.known < tot.n THEN 'One or more radiology names are invalid.' WHEN tot.n IS NULL THEN 'The order has no examinations.'
              WHEN k.request_id IS NOT NULL THEN 'Patient already booked one or more of these tests today.'
              WHEN tot.names < tot.n THEN 'An examination is listed more than once.' END AS refused
          FROM asked a LEFT JOIN tot ON tot.request_id = a.request_id LEFT JOIN booked k ON k.request_id = a.request_id),
    free AS (SELECT t.request_id, t.request_ts, t.p_id, CAST(t.request_ts AS DATE) AS d, t.n, p.name FROM t JOIN priced p ON p.request_id = t.request_id WHERE refused IS NULL),
    singles AS (SELECT p_id, d, name, min((request_ts, request_id)) AS k FROM free WHERE n = 1 GROUP BY 1, 2, 3),
    blocked AS (SELECT DISTINCT f.request_id FROM free f JOIN singles s ON s.p_id = f.p_id AND s.d = f.d AND s.name = f.name WHERE (f.request_ts, f.request_id) > s.k),
    f AS (SELECT t.*, coalesce(refused, CASE WHEN b.request_id IS NOT NULL THEN 'Patient already booked one or more of these tests today.' END) AS why
          FROM t LEFT JOIN blocked b ON b.request_id = t.request_id),
    ids AS (SELECT *, row_number() OVER (ORDER BY request_ts, request_id) + (SELECT max(l_orderkey) FROM lineitem) AS reservation_id,
                   row_number() OVER (ORDER BY request_ts, request_id) + (SELECT max(o_orderkey) FROM orders) AS invoice_id FROM f WHERE why IS NULL)""",
)


def weekly_clinic(r: Roles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders moved to the Monday of their week, few patients and few examinations: repeats are common."""
    week = F.date_trunc("week", F.col("request_ts")).cast("timestamp_ntz")
    asked = r.orders.select(
        "request_id",
        (week + (F.col("request_ts") - F.date_trunc("day", F.col("request_ts")).cast("timestamp_ntz"))).alias("request_ts"),
        (F.col("p_id") % 40).alias("p_id"),
        "payment_method",
    )
    number = F.expr("try_cast(substr(name, 6) as int)") % 12
    lines = r.exam_lines.withColumn(
        "name", F.when(F.col("name").startswith("EXAM"), F.concat(F.lit("EXAM "), number.cast("string"))).otherwise(F.col("name"))
    )
    orders = r.table("orders").filter("o_orderpriority = '1-URGENT'")
    stored = orders.select(
        F.col("o_orderkey").alias("reservation_id"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"),
        (F.col("o_custkey") % 40).alias("p_id"),
        F.concat(F.lit("Exam "), (F.col("o_orderkey") % 12).cast("string")).alias("rad_name"),
    )
    highest = r.table("lineitem").agg(F.max("l_orderkey").alias("reservation_id")).select(
        "reservation_id",
        F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("long").alias("p_id"),
        F.lit(None).cast("string").alias("rad_name"),
    )
    return asked, lines, stored.unionByName(highest)


def radiology(r: Roles):
    asked, lines, stored = weekly_clinic(r)
    return diagnostics.book_radiology(
        asked,
        lines,
        exam_state(r, "rad_id", "rad_name"),
        r.patient,
        r.employee,
        r.weekly,
        r.emp_shift,
        r.order_shifts,
        stored,
        r.invoice,
    )


@registry.add(
    "book_radiology",
    RADIOLOGY
    + f"""
    SELECT f.request_id, i.request_id IS NOT NULL AS accepted, coalesce(i.reservation_id, -1) AS reservation_id, coalesce(i.invoice_id, -1) AS invoice_id,
           coalesce(f.why, 'Radiology reservation completed. Total = ' || {amount_text('CAST(f.cents AS BIGINT)')}
             || ' | Reservation ID = ' || i.reservation_id || ' | Invoice = ' || i.invoice_id) AS message
    FROM f LEFT JOIN ids i ON i.request_id = f.request_id""",
)
def book_radiology(r: Roles) -> DataFrame:
    return radiology(r).outcomes.withColumns(or_minus_one("reservation_id", "invoice_id"))


@registry.add(
    "book_radiology_lines",
    RADIOLOGY
    + f"""
    SELECT i.invoice_id, i.reservation_id, 'Radiology' AS reservation_type, p.item_id AS process_id, {amount('p.cents')} AS unit_price,
           1 AS quantity, {amount('p.cents')} AS total, 14 AS dept_id
    FROM ids i JOIN priced p ON p.request_id = i.request_id""",
)
def book_radiology_lines(r: Roles) -> DataFrame:
    return radiology(r).tables["invoice_details"]


@registry.add(
    "post_results",
    """WITH reserve AS (SELECT l_partkey AS item_id, l_orderkey AS reservation_id, l_linestatus AS test_result FROM lineitem),
    posted AS (SELECT l_orderkey AS reservation_id, 'exam ' || l_partkey AS name,
                      max((l_shipdate, l_suppkey * 10 + l_linenumber)) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT r.item_id, r.reservation_id, CASE WHEN p.k IS NOT NULL THEN 'R' || p.k[2] ELSE r.test_result END AS test_result
    FROM reserve r LEFT JOIN posted p ON p.reservation_id = r.reservation_id AND p.name = 'exam ' || r.item_id""",
)
def post_results(r: Roles) -> DataFrame:
    lines = r.table("lineitem")
    reserve = lines.select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_orderkey").alias("reservation_id"),
        F.col("l_linestatus").alias("test_result"),
    )
    number = F.col("l_suppkey") * 10 + F.col("l_linenumber")
    results = lines.filter("l_returnflag = 'R'").select(
        number.alias("request_id"),
        F.col("l_shipdate").alias("request_ts"),
        F.col("l_orderkey").alias("reservation_id"),
        F.concat(F.lit("EXAM "), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("R"), number.cast("string")).alias("test_result"),
    )
    return diagnostics.post_results(results, reserve, r.exams, "item_id", "name")


# Expense names asked for; the last one is not a known type.
ASKED_TYPES = ("africa", "america", "asia", "europe", "middle east", "zoo")

EXPENSES = with_roles(
    "ev",
    f"""asked AS (SELECT request_id, request_ts, emp_id AS branch, CAST(request_ts AS DATE) + CAST(request_id % 90 AS INTEGER) AS date, cents,
             ['{"', '".join(ASKED_TYPES)}'][CAST(request_id % 6 AS INTEGER) + 1] AS kind FROM ev),
    f AS (SELECT a.*, r.r_regionkey AS expense_id, date_trunc('month', date) AS m,
                 row_number() OVER (PARTITION BY branch, kind, date_trunc('month', date) ORDER BY request_ts, request_id) AS place,
                 date_trunc('month', date) = DATE '2024-02-01' AND r.r_regionkey = 2 AS on_file
          FROM asked a LEFT JOIN region r ON lower(r.r_name) = a.kind)""",
)


@registry.add(
    "expense_monthly_unique",
    EXPENSES
    + """
    SELECT request_id, expense_id IS NOT NULL AND NOT on_file AND place = 1 AS accepted,
           CASE WHEN expense_id IS NULL THEN 'Invalid expense type.' WHEN on_file OR place > 1 THEN 'Expense for this type already exists this month.'
                ELSE 'Expense added successfully.' END AS message FROM f""".replace(
        "expense_id IS NOT NULL AND NOT on_file", "expense_id IS NOT NULL AND NOT coalesce(on_file, false)"
    ),
)
def expense_monthly_unique(r: Roles) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ASKED_TYPES]), (F.col("request_id") % 6 + 1).cast("int"))
    asked = r.events.select(
        "request_id",
        "request_ts",
        F.col("emp_id").alias("branch"),
        F.date_add(F.to_date("request_ts"), (F.col("request_id") % 90).cast("int")).alias("date"),
        kinds.alias("expense_type"),
        "amount",
    )
    types = r.table("region").select(F.col("r_name").alias("expense_type"), F.col("r_regionkey").alias("expense_id"))
    on_file = r.events.select(
        F.lit(2).alias("expense_id"), F.lit("2024-02-10").cast("date").alias("date"), F.col("emp_id").alias("branch")
    ).distinct()
    return diagnostics.add_expenses(asked, types, on_file, scope=("branch",)).outcomes
