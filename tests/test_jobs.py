"""Jobs against one-request-at-a-time loops and hand-made rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.frames import D, TS, frame, many_ranges, messages, rows, table
from wardflow.functions.clock import moment
from wardflow.plans import attendance, clinic, diagnostics, payroll, pharmacy, rooms, staffing, surgery

NOON = TS(2024, 1, 10, 12)


def staff(spark, *people):
    """(emp_id, type, status, salary, dept_id)"""
    return table(
        spark,
        "employee",
        [
            dict(emp_id=e, fname=f"f{e}", lname="l", type=t, status=s, salary=Decimal(p), dept_id=d, ssn=f"S{e}", phone=f"p{e}", email=f"m{e}")
            for e, t, s, p, d in people
        ],
    )


def desk(spark):
    """A receptionist (id 90) on a shift around the clock, by date and by clock."""
    people = staff(spark, (90, "receptionist", "Active", 100, 1), (91, "Receptionist", "Active", 100, 1))
    emp_shift = table(spark, "emp_shift", [dict(emp_id=90, shift_id=1), dict(emp_id=91, shift_id=1)])
    dated = table(
        spark, "shift_appointment", [dict(shift_id=1, shift_type="x", date=D(2024, 1, 10), start_time=1, end_time=86399)]
    )
    return people, emp_shift, dated


# ---------------------------------------------------------------- attendance


def test_check_in_guards(spark):
    people = staff(spark, (1, "nurse", "active", 900, 1), (2, "nurse", "INACTIVE", 900, 1), (3, "nurse", "active", 900, 1))
    on_file = table(spark, "attendance", [dict(attend_id=1, emp_id=3, checkin=NOON, attend_date=NOON.date())])
    asked = frame(
        spark,
        [(1, TS(2024, 1, 10, 9), 1), (2, TS(2024, 1, 10, 8), 1), (3, NOON, 2), (4, NOON, 3), (5, NOON, 9), (6, TS(2024, 1, 11, 8), 3)],
        "request_id int, request_ts timestamp_ntz, emp_id int",
    )
    result = attendance.check_in(asked, people, on_file)
    assert messages(result) == {
        1: "Employee already checked in today",
        2: "Check-in recorded successfully",
        3: "Employee is inactive and cannot check in",
        4: "Employee already checked in today",
        5: "Employee not found in the system",
        6: "Check-in recorded successfully",
    }
    assert result.tables["attendance"].count() == 3


def test_check_out_after_midnight_finds_no_check_in(spark):
    on_file = table(spark, "attendance", [dict(attend_id=1, emp_id=3, checkin=TS(2024, 1, 10, 20), attend_date=D(2024, 1, 10))])
    asked = frame(
        spark,
        [(1, TS(2024, 1, 11, 0, 30), 3), (2, TS(2024, 1, 10, 23), 3), (3, TS(2024, 1, 10, 23, 30), 3)],
        "request_id int, request_ts timestamp_ntz, emp_id int",
    )
    result = attendance.check_out(asked, on_file)
    assert messages(result) == {
        1: "No check-in found for this employee today",
        2: "Checkout recorded successfully",
        3: "Employee already checked out today",
    }
    assert rows(result.tables["attendance"], "checkout") == [(TS(2024, 1, 10, 23),)]


def test_midnight_ends(spark):
    day = frame(spark, [(D(2024, 1, 10), 61200, 0), (D(2024, 1, 10), 79200, 21600), (D(2024, 1, 10), 32400, 57600)], "d date, s int, e int")
    ends = [r[0] for r in day.orderBy("s").select(attendance.shift_end("d", "s", "e")).collect()]
    assert ends == [TS(2024, 1, 10, 16), TS(2024, 1, 10, 23, 59), TS(2024, 1, 11, 6)]


def test_missing_checkout_doubles_with_two_slots_and_replaces_the_day(spark):
    people = staff(spark, (1, "DOCTOR", "active", "3000", 1), (2, "nurse", "active", "100", 1), (3, "nurse", "active", "1", 1))
    day = D(2024, 1, 10)
    on_file = table(
        spark,
        "attendance",
        [dict(attend_id=i, emp_id=e, checkin=TS(2024, 1, 10, 9), attend_date=day) for i, e in enumerate((1, 2, 3))],
    )
    weekly = table(
        spark,
        "doctor_appointments",
        [dict(id=i, examination_price=1, day="Wednesday", shift_start=s, shift_end=e, emp_id=1, dept_id=1) for i, s, e in ((1, 32400, 50400), (2, 54000, 61200))],
    )
    dated = table(spark, "shift_appointment", [dict(shift_id=1, shift_type="x", date=day, start_time=0, end_time=43200)])
    emp_shift = table(spark, "emp_shift", [dict(emp_id=2, shift_id=1)])
    old = frame(spark, [(1, "Manual - x", day, Decimal("5.00")), (3, "kept", day, Decimal("1.00"))], "emp_id int, type string, date date, amount decimal(18,2)")
    result = attendance.missing_checkout(on_file, people, weekly, dated, emp_shift, old, moment("2024-01-10 17:30:01"))
    assert rows(result.tables["deduction"], "emp_id", "amount") == [
        (1, Decimal("100.00")), (1, Decimal("100.00")), (2, Decimal("3.33")), (3, Decimal("1.00"))
    ]
    assert rows(result.tables["attendance"], "emp_id", "checkout") == [(1, TS(2024, 1, 10, 14)), (2, TS(2024, 1, 10, 12)), (3, None)]


# ------------------------------------------------------------------- payroll


def test_payroll_twice_is_payroll_once(spark):
    people = staff(spark, (1, "nurse", "Active", "1000", 1), (2, "nurse", "inactive", "500", 1), (3, "nurse", "active", "700", 1))
    money_ddl = "emp_id int, type string, date date, amount decimal(18,2)"
    reward = frame(spark, [(1, "r", D(2024, 1, 31), Decimal("10.50")), (1, "r", D(2024, 2, 1), Decimal("99.00")), (2, "r", D(2024, 1, 1), Decimal("1.00"))], money_ddl)
    deduction = frame(spark, [(1, "d", D(2024, 1, 2), Decimal("0.25"))], money_ddl)
    salary = frame(
        spark,
        [(2, D(2024, 1, 1), Decimal("1.00"), Decimal("0.00"), Decimal("0.00")), (3, D(2023, 12, 1), Decimal("7.00"), Decimal("0.00"), Decimal("0.00"))],
        "emp_id int, date date, salary decimal(18,2), total_reward decimal(18,2), total_deduction decimal(18,2)",
    )
    month = F.lit("2024-01-01")
    first = payroll.monthly_salary(people, salary, reward, deduction, month)
    assert rows(first, "emp_id", "date", "salary") == [
        (1, D(2024, 1, 1), Decimal("1010.25")), (2, D(2024, 1, 1), Decimal("501.00")), (3, D(2023, 12, 1), Decimal("7.00")), (3, D(2024, 1, 1), Decimal("700.00"))
    ]
    assert rows(payroll.monthly_salary(people, first, reward, deduction, month)) == rows(first)


def raise_loop(requests, salaries):
    out, refused = dict(salaries), set()
    for rid, _, emp, pct in sorted(requests, key=lambda r: (r[1], r[0])):
        if emp not in out or pct <= 0:
            refused.add(rid)
            continue
        grown = (out[emp] + out[emp] * pct / 100).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        if grown >= Decimal("100000000"):
            refused.add(rid)
        else:
            out[emp] = grown
    return out, refused


def test_raises_compound_and_stop_at_the_column_limit(spark):
    rng = random.Random(3)
    requests = [(i, rng.randrange(60), rng.choice([1, 1, 1, 2, 3, 4, 9]), Decimal(rng.choice(["0", "0.01", "3.33", "250", "999.99", "1"]))) for i in range(90)]
    salaries = {1: Decimal("9000.55"), 2: Decimal("0.01"), 3: Decimal("50.00"), 4: Decimal("0.00")}
    people = staff(spark, *[(e, "nurse", "active", s, 1) for e, s in salaries.items()])
    result = payroll.raise_by_employee(frame(spark, requests, "request_id int, request_ts int, emp_id int, increase_percent decimal(5,2)"), people)
    expected, refused = raise_loop(requests, salaries)
    assert dict(rows(result.tables["employee"], "emp_id", "salary")) == expected
    assert {r.request_id for r in result.outcomes.filter("not accepted").collect()} == refused


def test_many_raises_of_one_person(spark):
    """A hundred thousand raises pass in one go; those that do not fit fail, smaller ones after them still count."""
    rng = random.Random(8)
    requests = [(i, i, 1, Decimal(rng.choice(["0.01", "0.02", "0.05", "3.00"]))) for i in range(100_000)]
    people = staff(spark, (1, "nurse", "active", "9000.55", 1), (2, "nurse", "active", "1", 1))
    asked = spark.createDataFrame(requests, "request_id int, request_ts int, emp_id int, increase_percent decimal(5,2)")
    result = payroll.raise_by_employee(asked, people)
    expected, refused = raise_loop(requests, {1: Decimal("9000.55")})
    assert dict(rows(result.tables["employee"], "emp_id", "salary")) == {**expected, 2: Decimal("1.00")}
    assert {r.request_id for r in result.outcomes.filter("not accepted").collect()} == refused and len(refused) > 1000


def test_department_raise_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(payroll, "RAISES_PER_ROUND", 3)
    people = staff(spark, (1, "n", "active", "100.10", 1), (2, "n", "Inactive", "100.10", 1), (3, "n", "active", "7.77", 1), (4, "n", "active", "5", 2))
    departments = table(spark, "department", [dict(dept_id=1, dept_name="a"), dict(dept_id=3, dept_name="c")])
    asked = [(i, i, 1, Decimal("3.33")) for i in range(8)] + [(20, 0, 2, Decimal("1")), (21, 0, 3, Decimal("1")), (22, 0, 1, Decimal("0"))]
    result = payroll.raise_by_department(frame(spark, asked, "request_id int, request_ts int, dept_id int, increase_percent decimal(5,2)"), people, departments)
    e1, _ = raise_loop([(i, i, 1, Decimal("3.33")) for i in range(8)], {1: Decimal("100.10")})
    e3, _ = raise_loop([(i, i, 3, Decimal("3.33")) for i in range(8)], {3: Decimal("7.77")})
    assert dict(rows(result.tables["employee"], "emp_id", "salary")) == {1: e1[1], 2: Decimal("100.10"), 3: e3[3], 4: Decimal("5.00")}
    said = messages(result)
    assert said[20] == "Department does not exist." and said[21].startswith("No active employees") and said[22].startswith("Increase percent")


def test_department_raise_of_many_steps_takes_one_round(spark, monkeypatch):
    written, write = [], payroll.materialize
    monkeypatch.setattr(payroll, "materialize", lambda df, label: written.append(label) or write(df, label))
    rng = random.Random(5)
    steps = [(i, i, 1, Decimal(rng.choice(["0.01", "0.03", "0.40"]))) for i in range(1_600)]
    people = staff(spark, *[(i, "n", "active", str(i * 7 + Decimal("0.33")), 1) for i in range(1, 40)], (90, "n", "active", "-8.01", 1), (91, "n", "active", "12.5", 2))
    departments = table(spark, "department", [dict(dept_id=1, dept_name="a"), dict(dept_id=2, dept_name="b")])
    asked = frame(spark, steps, "request_id int, request_ts int, dept_id int, increase_percent decimal(5,2)")
    result = payroll.raise_by_department(asked, people, departments)
    got = dict(rows(result.tables["employee"], "emp_id", "salary"))
    for person in people.collect():
        want, _ = raise_loop([(i, t, person.emp_id, p) for i, t, _, p in steps], {person.emp_id: person.salary})
        assert got[person.emp_id] == (want[person.emp_id] if person.dept_id == 1 else person.salary)
    assert len(written) <= 3


# ------------------------------------------------------------------ schedule


@pytest.mark.parametrize(
    "days,expected",
    [
        ([D(2025, 2, 1), D(2025, 2, 27), D(2025, 2, 28)], [D(2025, 3, 1), D(2025, 3, 27), D(2025, 3, 28), D(2025, 3, 29)]),
        ([D(2024, 2, 28), D(2024, 2, 29)], [D(2024, 3, 28), D(2024, 3, 29), D(2024, 3, 30)]),
        ([D(2024, 12, 31), D(2024, 12, 1)], [D(2025, 1, 1), D(2025, 1, 31)]),
        ([D(2024, 3, 30), D(2024, 3, 31)], [D(2024, 4, 30)]),
        ([D(2024, 4, 29), D(2024, 4, 30)], [D(2024, 5, 29), D(2024, 5, 30), D(2024, 5, 31)]),
    ],
)
def test_schedule_roll_over(spark, days, expected):
    dated = table(spark, "shift_appointment", [dict(shift_id=1, shift_type="m", date=d, start_time=0, end_time=1) for d in days])
    out = [r[0] for r in rows(staffing.repeat_schedule(dated), "date")]
    assert out == sorted(days + expected)


# ------------------------------------------------- departments and employees


def test_hire_matches_a_loop(spark):
    rng = random.Random(11)
    people = staff(spark, (1, "n", "active", 1, 1), (2, "n", "Inactive", 1, 1))
    departments = table(spark, "department", [dict(dept_id=1, dept_name="a")])
    asked = []
    for i in range(70):
        asked.append((i, rng.randrange(50), rng.choice([None, "s1", "S2", *[f"x{k}" for k in range(25)]]), rng.choice([None, "p1", *[f"q{k}" for k in range(30)]]), rng.choice(["m2", *[f"M{k}" for k in range(40)]]), rng.choice([1, 1, 1, 7])))
    df = frame(spark, asked, "request_id int, request_ts int, ssn string, phone string, email string, dept_id int")
    df = df.select(
        "*", F.lit("a").alias("fname"), F.lit("b").alias("lname"), F.lit("Male").alias("gender"), F.lit("1990-01-01").cast("date").alias("birth_date"),
        F.lit(5).cast("decimal(10,2)").alias("salary"), F.lit("n").alias("type"), F.lit(None).cast("date").alias("start_job"),
        F.lit(None).cast("date").alias("end_job"), F.expr("CASE WHEN request_id % 4 = 0 THEN 'Inactive' END").alias("status"),
    )
    result = staffing.hire(df, people, departments, moment("2024-01-10 00:00:00"))
    status = {"s1": "active", "s2": "inactive"}
    phones, emails, expected, next_id = {"p1", "p2"}, {"m1", "m2"}, {}, 3
    for rid, _, ssn, phone, email, dept in sorted(asked, key=lambda r: (r[1], r[0])):
        key, mail = ssn.lower() if ssn else None, email.lower()
        if status.get(key) == "inactive":
            text = "This Employee cannot be re-hired because he/she is inactive"
        elif status.get(key) == "active":
            text = staffing.WORKING
        elif phone in phones:
            text = staffing.PHONE_USED
        elif mail in emails:
            text = staffing.EMAIL_USED
        elif dept != 1:
            text = staffing.NO_DEPARTMENT
        else:
            text = f"Employee Added Successfully {next_id}"
            next_id += 1
            if key:
                status[key] = "inactive" if rid % 4 == 0 else "active"
            if phone:
                phones.add(phone)
            emails.add(mail)
        expected[rid] = text
    got = {r.request_id: r.message + (f" {r.emp_id}" if r.accepted else "") for r in result.outcomes.collect()}
    assert got == expected
    assert result.tables["employee"].count() == next_id - 1


def test_departments_match_a_loop(spark):
    rng = random.Random(12)
    people = staff(spark, *[(i, "n", "active" if i % 5 else "Inactive", 1, 1) for i in range(1, 13)])
    departments = table(spark, "department", [dict(dept_id=4, dept_name="Lab", manager_id=1)])
    asked = [(i, rng.randrange(30), rng.choice(["LAB", *[f"d{k}" for k in range(14)]]), rng.choice([None, 99, *range(1, 13)])) for i in range(60)]
    result = staffing.add_departments(frame(spark, asked, "request_id int, request_ts int, dept_name string, manager_id int"), departments, people)
    names, managers, expected, next_id = {"lab"}, {1}, {}, 5
    for rid, _, name, boss in sorted(asked, key=lambda r: (r[1], r[0])):
        if name.lower() in names:
            text = "This department name already exists"
        elif boss is not None and boss > 12:
            text = "Manager ID not found in Employee table"
        elif boss is None or boss % 5 == 0:
            text = "This manager is inactive can not be a manager"
        elif boss in managers:
            text = staffing.MANAGER_BUSY
        else:
            text = f"Department added successfully {next_id}"
            next_id += 1
            names.add(name.lower())
            managers.add(boss)
        expected[rid] = text
    got = {r.request_id: r.message + (f" {r.dept_id}" if r.accepted else "") for r in result.outcomes.collect()}
    assert got == expected


def test_department_keeps_its_manager_only_without_compat(spark):
    people = staff(spark, (1, "n", "active", 1, 1))
    departments = table(spark, "department", [dict(dept_id=4, dept_name="Lab", manager_id=1)])
    asked = frame(spark, [(1, 1, 4, "Labs", 1)], "request_id int, request_ts int, dept_id int, dept_name string, manager_id int")
    assert messages(staffing.update_departments(asked, departments, people))[1] == staffing.MANAGER_BUSY
    free = staffing.update_departments(asked, departments, people, compat=False)
    assert messages(free)[1] == "Department updated successfully"
    assert rows(free.tables["department"], "dept_name", "manager_id") == [("Labs", 1)]


def test_shift_moves_follow_each_other(spark):
    people = staff(spark, (1, "n", "active", 1, 1), (2, "n", "active", 1, 1))
    shifts = table(spark, "shift", [dict(shift_id=i, shift_name=f"s{i}") for i in (1, 2, 3)])
    held = table(spark, "emp_shift", [dict(emp_id=1, shift_id=1)])
    asked = frame(spark, [(1, 1, 1, 2), (2, 2, 1, 2), (3, 3, 1, 1), (4, 4, 1, 9), (5, 5, 1, 1), (6, 1, 2, 3)], "request_id int, request_ts int, emp_id int, shift_id int")
    result = staffing.move_shift(asked, people, shifts, held)
    same, moved = "This employee already exists in this shift", "Shift has been modified successfully"
    assert messages(result) == {1: moved, 2: same, 3: moved, 4: "The new shift does not exist", 5: same, 6: moved}
    assert rows(result.tables["emp_shift"]) == [(1, 1)]


# -------------------------------------------------------------------- clinic


def test_booking_respects_the_cap_and_the_midnight_trap(spark):
    people, emp_shift, dated = desk(spark)
    weekly = table(
        spark,
        "doctor_appointments",
        [dict(id=i, examination_price=300, day="Wednesday", shift_start=s, shift_end=e, emp_id=d, dept_id=p) for i, s, e, d, p in ((1, 32400, 57600, 5, 1), (2, 32400, 57600, 6, 1), (3, 61200, 0, 7, 2))],
    )
    stored = table(spark, "appointment_reservation", [dict(reservation_id=40 + i, date_time=TS(2024, 1, 10, 8), p_id=1, dept_id=1, doctor_id=5) for i in range(18)])
    invoice = table(spark, "invoice", [dict(invoice_id=7, date=D(2024, 1, 1), payment_method="x", p_id=1, emp_id=1)])
    asked = frame(
        spark,
        [(1, NOON, 1, 1, "cash"), (2, NOON, 1, 1, "cash"), (3, NOON, 1, 1, "cash"), (4, NOON, 1, 3, "cash"), (5, TS(2024, 1, 10, 18), 1, 2, "cash"), (6, TS(2024, 1, 17, 12), 1, 1, "cash")],
        "request_id int, request_ts timestamp_ntz, p_id int, dept_id int, payment_method string",
    )
    said = messages(clinic.book_doctor(asked, weekly, people, emp_shift, dated, stored, invoice))
    assert said == {
        1: "✔ Reservation completed successfully. Reservation ID = 58, Assigned Doctor ID = 5",
        2: "✔ Reservation completed successfully. Reservation ID = 59, Assigned Doctor ID = 5",
        3: "❌ Maximum daily reservations reached for this doctor.",
        4: "❌ This department has no registered doctors.",
        5: "❌ No doctors available now for this department.",
        6: "❌ No receptionist available now.",
    }


# ------------------------------------------------------------------ pharmacy


def test_lines_of_a_request_are_brought_together_once(spark, monkeypatch):
    """Lines go to the task of their request as they are; sorting them before and after that would be work done twice."""
    plans, write = {}, pharmacy.materialize

    def seen(df, label, *folders):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *folders)

    monkeypatch.setattr(pharmacy, "materialize", seen)
    result = pharmacy.prescription_sale(
        frame(spark, [(1, 1, 7, "cash", 5), (2, 2, 7, "cash", 5), (3, 3, 9, "cash", 5)], "request_id int, request_ts int, prescription_id int, payment_method string, emp_id int"),
        frame(spark, [(1, "b", 2), (1, " A", 1), (1, "a", 1), (2, "a", 1), (3, "a", 9)], "request_id int, drug_name string, req_qty int"),
        frame(spark, [(7, 1)], "prescription_id int, p_id int"),
        frame(spark, [], "prescription_id int, drug_id int, quantity int, total_price decimal(10,2)"),
        table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name=n, quantity=3, price=Decimal(2), exp_date=D(2030, 1, 1), prod_date=D(2020, 1, 1)) for i, n in ((1, "a"), (2, "b"))]),
        frame(spark, [], "drug_id int, drug_name string, current_qty int, alert_date timestamp_ntz"),
        table(spark, "invoice", []),
        moment("2024-01-10 12:00:00"),
    )
    sold = "Sale completed successfully.\rTotal Invoice Amount: 8.00\rRemaining Stock:\r•  A: 1\r• b: 1\r"
    said = {r["request_id"]: (r["accepted"], r["message"], r["total"]) for r in result.outcomes.collect()}
    assert said == {
        1: (True, sold, Decimal("8.00")),
        2: (False, "This prescription has already been processed.", None),
        3: (False, "Prescription not found.", None),
    }
    lines = [part for part in plans["named"].splitlines() if "hashpartitioning(request_id" in part]
    assert len(lines) == 1 and "_name" not in lines[0].split("hashpartitioning(")[1].split(")")[0]


def test_reports_of_sales_are_built_where_lines_are_counted(spark, monkeypatch):
    """Lines counted by drug are not moved back to their requests; requests without lines, and drugs without stock, are answered."""
    plans, write = [], pharmacy.materialize

    def seen(df, label, *folders):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *folders)

    monkeypatch.setattr(pharmacy, "materialize", seen)
    with many_ranges(spark):
        result = pharmacy.prescription_sale(
            frame(spark, [(i, i, i, "cash", 5) for i in range(1, 6)], "request_id int, request_ts int, prescription_id int, payment_method string, emp_id int"),
            frame(spark, [(1, "b", 2), (1, "A ", 1), (1, "a", 1), (2, "B", 2), (2, " a", 1), (4, "b", 1), (5, None, 1)], "request_id int, drug_name string, req_qty int"),
            frame(spark, [(i, i) for i in range(1, 6)], "prescription_id int, p_id int"),
            frame(spark, [], "prescription_id int, drug_id int, quantity int, total_price decimal(10,2)"),
            table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name=n, quantity=3, price=Decimal(2), exp_date=D(2030, 1, 1), prod_date=D(2020, 1, 1)) for i, n in ((1, "a"), (2, "b"))]),
            frame(spark, [], "drug_id int, drug_name string, current_qty int, alert_date timestamp_ntz"),
            table(spark, "invoice", []),
            moment("2024-01-10 12:00:00"),
        )
        done = "Sale completed successfully.\rTotal Invoice Amount: %s\rRemaining Stock:\r%s"
        said = {r["request_id"]: (r["message"], r["total"]) for r in result.outcomes.collect()}
        assert said == {
            1: (done % ("8.00", "• A : 1\r• b: 1\r"), Decimal("8.00")),
            2: (done % ("4.00", "•  a: 0\r• B: 0\r"), Decimal("4.00")),
            3: (done % ("0.00", ""), Decimal("0.00")),
            4: (done % ("0.00", "• b: 0\r"), Decimal("0.00")),
            5: ("One or more drugs not found in inventory.", None),
        }
        assert rows(result.tables["invoice_details"], "reservation_id", "process_id", "quantity") == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 1)]
        assert rows(result.tables["stock_report"], "request_id", "drug_id") == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 2)]
    reports = [plan for plan in plans if "collect_list" in plan]
    assert len(reports) == 1 and "hashpartitioning(request_id" not in reports[0]


def test_sales_match_a_loop(spark):
    rng = random.Random(21)
    drugs = [(i, f"Drug {i % 7}", rng.choice([0, 5, 10, 40, 100]), Decimal(rng.randrange(1, 900)) / 100) for i in range(1, 10)]
    lookup = {}
    for d in drugs:
        lookup.setdefault(d[1].lower(), d[0])
    requests = [(i, rng.randrange(30), rng.randrange(1, 26)) for i in range(40)]
    lines = [(r[0], rng.choice([f" DRUG {k} " for k in range(7)] * 4 + ["nope"]), rng.randrange(1, 15)) for r in requests for _ in range(rng.randrange(1, 4))]
    stock_df = table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name=n, quantity=q, price=p, exp_date=D(2030, 1, 1), prod_date=D(2020, 1, 1)) for i, n, q, p in drugs])
    prescriptions = frame(spark, [(i, i) for i in range(1, 23)], "prescription_id int, p_id int")
    sold = frame(spark, [(3, 1, 1, Decimal("1.00"))], "prescription_id int, drug_id int, quantity int, total_price decimal(10,2)")
    alerts = frame(spark, [(9, "Drug 2", 3, NOON)], "drug_id int, drug_name string, current_qty int, alert_date timestamp_ntz")
    invoice = table(spark, "invoice", [])
    with many_ranges(spark):
        result = pharmacy.prescription_sale(
            frame(spark, [(*r, "cash", 5) for r in requests], "request_id int, request_ts int, prescription_id int, payment_method string, emp_id int"),
            frame(spark, lines, "request_id int, drug_name string, req_qty int"),
            prescriptions, sold, stock_df, alerts, invoice, moment("2024-01-10 12:00:00"),
        )
        stock = {i: q for i, _, q, _ in drugs}
        sales, seen, kinds = [], {}, {}
        for rid, _, pid in sorted(requests, key=lambda r: (r[1], r[0])):
            wanted = {}
            for r, name, qty in lines:
                if r == rid:
                    wanted[name.strip().lower()] = wanted.get(name.strip().lower(), 0) + qty
            if pid > 22:
                kinds[rid] = "Prescription not found."
            elif pid == 3:
                kinds[rid] = "This prescription has already been processed."
            elif any(n not in lookup for n in wanted):
                kinds[rid] = "One or more drugs not found in inventory."
            elif pid in seen:
                kinds[rid] = "This prescription has already been processed." if seen[pid] else "Deferred to the next batch."
            else:
                seen[pid] = False
                kinds[rid] = "Sale completed successfully."
                for name, qty in wanted.items():
                    give = min(qty, stock[lookup[name]])
                    stock[lookup[name]] -= give
                    if give:
                        seen[pid] = True
                        sales.append((pid, lookup[name], give))
        assert {k: v.split("\r")[0] for k, v in messages(result).items()} == kinds
        assert rows(result.tables["prescription_drugs"], "prescription_id", "drug_id", "quantity") == sorted(sales)
        assert dict(rows(result.tables["pharmacy_drugs"], "drug_id", "quantity")) == stock
        billed = sum(r.paid_money for r in result.tables["invoice"].collect())
        assert billed == sum(r.total for r in result.tables["invoice_details"].collect())
        ids = sorted(r.invoice_id for r in result.tables["invoice"].collect())
        assert ids == list(range(1, len(ids) + 1)) and set(r.invoice_id for r in result.tables["invoice_details"].collect()) == set(ids)
    low = {r.drug_id: r.current_qty for r in result.tables["low_stock_alerts"].collect()}
    assert low[9] == 3 and all(q < 10 for q in low.values())


def test_expiry_bounds(spark):
    from wardflow.plans import reports

    days = [D(2025, 11, 29), D(2025, 11, 30), D(2026, 2, 28), D(2026, 3, 1)]
    drugs = table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name="x", quantity=1, exp_date=d, prod_date=d, price=Decimal(1)) for i, d in enumerate(days)])
    ids = lambda at: [r.drug_id for r in reports.expiry_alert(drugs, moment(at)).collect()]
    assert ids("2025-11-30 08:00:00") == [2]
    assert ids("2025-11-30 00:00:00") == [1, 2]


def test_restock_rounds_the_cost_and_clears_alerts(spark):
    drugs = table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name="x", quantity=i, exp_date=D(2030, 1, 1), prod_date=D(2020, 1, 1), price=p) for i, p in ((1, Decimal("0.05")), (2, Decimal("99.99")))])
    alerts = frame(spark, [(2, "x", 2, NOON), (2, "x", 2, NOON)], "drug_id int, drug_name string, current_qty int, alert_date timestamp_ntz")
    result = pharmacy.restock_low(alerts, drugs, moment("2024-01-10 12:00:00"))
    assert rows(result.tables["drug_purchases"], "unit_cost", "total") == [(Decimal("69.99"), Decimal("3499.50"))] * 2
    assert rows(result.tables["pharmacy_drugs"], "drug_id", "quantity") == [(1, 1), (2, 52)]
    assert result.tables["low_stock_alerts"].isEmpty()
    nothing = pharmacy.restock_low(alerts.limit(0), drugs, moment("2024-01-10 12:00:00"))
    assert nothing.outcomes.first().message == "No low-stock drugs found. Nothing to purchase."


# ----------------------------------------------------------------- radiology


def test_radiology_repeats_in_the_batch_are_found_once(spark, monkeypatch):
    """Numbers and answers read who is blocked from one table, and totals bring the lines of a request together once."""
    plans, write = {}, diagnostics.materialize

    def seen(df, label, *folders):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *folders)

    monkeypatch.setattr(diagnostics, "materialize", seen)
    people, emp_shift, dated = desk(spark)
    people = people.unionByName(staff(spark, (50, "doctor", "active", 1, 14)))
    weekly = table(spark, "doctor_appointments", [dict(id=1, examination_price=1, day="Wednesday", shift_start=0, shift_end=1, emp_id=3, dept_id=3)])
    catalogue = table(spark, "radiology", [dict(rad_id=1, rad_name="Scan 1", delivery_duration=1, price=Decimal(10))])
    patients = table(spark, "patient", [dict(p_id=1, fname="a", lname="b", birth_date=D(1990, 1, 1), gender="Male")])
    result = diagnostics.book_radiology(
        frame(spark, [(i, TS(2024, 1, 10, 10, i), 1, "cash") for i in (1, 2)], "request_id int, request_ts timestamp_ntz, p_id int, payment_method string"),
        frame(spark, [(i, "scan 1") for i in (1, 2)], "request_id int, name string"),
        catalogue, patients, people, weekly, emp_shift, dated,
        frame(spark, [], "reservation_id int, date date, p_id int, rad_name string"),
        table(spark, "invoice", []),
    )
    assert [r["accepted"] for r in result.outcomes.orderBy("request_id").collect()] == [True, False]
    assert "blocked" in plans
    assert "min(struct" not in result.outcomes._jdf.queryExecution().optimizedPlan().toString()
    assert "hashpartitioning(request_id" in plans["asked"] and not any("item_id" in part.split("hashpartitioning(")[1].split(")")[0] for part in plans["asked"].splitlines() if "hashpartitioning(" in part)


@pytest.mark.parametrize("compat", [True, False])
def test_radiology_repeats_match_a_loop(spark, compat):
    rng = random.Random(31)
    people, emp_shift, dated = desk(spark)
    people = people.unionByName(staff(spark, (50, "doctor", "active", 1, 14)))
    weekly = table(spark, "doctor_appointments", [dict(id=1, examination_price=1, day="Wednesday", shift_start=0, shift_end=1, emp_id=3, dept_id=3)])
    catalogue = table(spark, "radiology", [dict(rad_id=i, rad_name=f"Scan {i}", delivery_duration=1, price=Decimal(10 * i)) for i in range(1, 5)])
    patients = table(spark, "patient", [dict(p_id=i, fname="a", lname="b", birth_date=D(1990, 1, 1), gender="Male") for i in (1, 2)])
    stored = [(1, D(2024, 1, 10), 1, "Scan 1"), (2, D(2024, 1, 10), 2, "Scan 1, Scan 2"), (3, D(2024, 1, 9), 2, "Scan 3")]
    requests = [(i, TS(2024, 1, 10, 9 + i % 9, rng.randrange(60)), rng.choice([1, 2, 3])) for i in range(30)]
    names = {r[0]: rng.sample(["scan 1", "SCAN 2", "Scan 3", "Scan 4"], rng.choice([1, 1, 2])) for r in requests}
    result = diagnostics.book_radiology(
        frame(spark, [(*r, "cash") for r in requests], "request_id int, request_ts timestamp_ntz, p_id int, payment_method string"),
        frame(spark, [(k, n) for k, v in names.items() for n in v], "request_id int, name string"),
        catalogue, patients, people, weekly, emp_shift, dated,
        frame(spark, stored, "reservation_id int, date date, p_id int, rad_name string"),
        table(spark, "invoice", []), compat=compat,
    )
    on_file = [(p, d, n.lower()) for _, d, p, n in stored]
    accepted = set()
    for rid, ts, pid in sorted(requests, key=lambda r: (r[1], r[0])):
        lower = [n.lower() for n in names[rid]]
        have = [n for p, d, n in on_file if p == pid and d == ts.date()]
        if not compat:
            have = [x for n in have for x in n.split(", ")]
        if pid == 3 or any(n in have for n in lower):
            continue
        accepted.add(rid)
        on_file.append((pid, ts.date(), ", ".join(sorted(lower))))
    assert {r.request_id for r in result.outcomes.filter("accepted").collect()} == accepted
    assert result.tables["invoice"].count() == len(accepted)


# --------------------------------------------------------------------- rooms


@pytest.mark.parametrize("seed", [41, 42])
def test_room_reservations_match_a_loop(spark, seed):
    rng = random.Random(seed)
    people, emp_shift, dated = desk(spark)
    kinds = ["Normal", "vip", "ICU", "none"]
    room = [(i, rng.choice(kinds[:3])) for i in range(1, 15)]
    status = [(i, rng.choice(["Available", "available", "Reserved"])) for i, _ in room]
    requests = [(i, TS(2024, 1, 10, rng.randrange(1, 23), rng.randrange(60)), rng.randrange(1, 16), rng.choice(kinds).lower()) for i in range(60)]
    stays = [(5, 1, None), (6, 2, D(2024, 1, 1))]
    with many_ranges(spark):
        result = rooms.reserve_room(
            frame(spark, requests, "request_id int, request_ts timestamp_ntz, p_id int, room_type string"),
            frame(spark, [(i,) for i in range(1, 14)], "p_id int"),
            frame(spark, room, "room_id int, room_type string"),
            frame(spark, status, "room_id int, status string"),
            frame(spark, stays, "reservation_id int, p_id int, checkout date"),
            people, emp_shift, dated,
        )
        got = messages(result)
    free = {}
    for (i, kind), (_, state) in zip(room, status):
        if state.lower() == "available":
            free.setdefault(kind.lower(), []).append(i)
    inside, next_id, expected = {1}, 7, {}
    for rid, _, pid, kind in sorted(requests, key=lambda r: (r[1], r[0])):
        if pid > 13:
            expected[rid] = "❌ Invalid patient ID."
        elif pid in inside:
            expected[rid] = "This Patient Is Reserved In Another Room Cant Reserve new Room"
        elif not free.get(kind):
            expected[rid] = "⚠ No available rooms of the selected type , All Reserved."
        else:
            expected[rid] = f"✅ Reservation added successfully. Room ID: {free[kind].pop(0)}, Reservation ID: {next_id}"
            next_id += 1
            inside.add(pid)
    assert got == expected


# ------------------------------------------------------------------- surgery


def surgery_loop(requests, kinds, ors, recovery, teams, slots, loads, mode):
    """One request after the other. slots: (date, room, doctor, patient, team, start, end)."""
    slots, loads, out = list(slots), dict(loads), {}

    def touches(a, b, s, e):
        return s <= a <= e or s <= b <= e or a <= s <= b

    for rid, _, date, pid, doc, kind, team, start in sorted(requests, key=lambda r: (r[1], r[0])):
        day = [s for s in slots if s[0] == date]
        if start is None or mode == "auto":
            free = {o: max([s[6] for s in day if s[1] == o], default=None) for o in ors}
            start, room = min((25200 if e is None else e + 3600, o) for o, e in free.items())
        else:
            room = next((o for o in ors if not any(s[1] == o and s[5] <= start <= s[6] for s in day)), None)
        if room is None or start + kinds[kind] * 60 > 86400:
            out[rid] = surgery.NO_ROOM
            continue
        end = start + kinds[kind] * 60
        if any((s[2] == doc or s[3] == pid) and touches(start, end, s[5], s[6]) for s in day):
            out[rid] = surgery.BUSY[mode]
            continue
        if team is not None:
            if mode == "manual" and any(s[4] == team and touches(start, end, s[5], s[6]) for s in day):
                out[rid] = surgery.TEAM_BUSY
                continue
        elif mode == "auto":
            team = next((t for t in teams if not any(s[4] == t and touches(start, end, s[5], s[6]) for s in day)), None)
            if team is None:
                out[rid] = surgery.NO_TEAM
                continue
        rest = min(recovery, key=lambda k: (loads.get((date, k), 0), k))
        loads[(date, rest)] = loads.get((date, rest), 0) + 1
        slots.append((date, room, doc, pid, team, start, end))
        out[rid] = (room, rest, start, end, team)
    return out


@pytest.mark.parametrize("mode", ["auto", "manual"])
def test_surgeries_match_a_loop(spark, mode):
    rng = random.Random(51)
    people, emp_shift, dated = desk(spark)
    people = people.unionByName(staff(spark, *[(i, "Consultant_Doctor", "active", 1, 1) for i in range(1, 8)]))
    kinds = {1: 60, 2: 240, 3: 500}
    dates = [D(2024, 1, 15), D(2024, 1, 16)]
    existing = [(D(2024, 1, 15), 1, 1, 99, 1, 25200, 36000), (D(2024, 1, 15), 2, 2, 98, 2, 28800, 32400), (D(2024, 1, 16), 1, 3, 5, 1, 25200, 30000)]
    requests = []
    for i in range(30):
        team = rng.choice([None, 1, 2, 3]) if mode == "auto" else rng.choice([1, 2, 3, 4])
        start = None if mode == "auto" else rng.choice([None, 25200, 30000, 43200, 60000])
        requests.append((i, TS(2024, 1, 10, 9, rng.randrange(60)), rng.choice(dates), rng.randrange(1, 12), rng.randrange(1, 8), rng.choice([1, 1, 2, 3]), team, start))
    surgeries = [(100 + n, d, s, e, Decimal(1), p, 1, r, t, doc, 1, "scheduled") for n, (d, r, doc, p, t, s, e) in enumerate(existing)]
    room = [(1, "surgery"), (2, "Surgery"), (3, "recovery"), (4, "RECOVERY"), (5, "normal")]
    stays = [(1, D(2024, 1, 14), D(2024, 1, 15), 3), (2, D(2024, 1, 16), D(2024, 1, 18), 4), (3, D(2024, 1, 1), None, 3)]
    loads = {(D(2024, 1, 15), 3): 1, (D(2024, 1, 16), 4): 1}
    df = frame(
        spark,
        [(i, ts, p, doc, f"op{k}", d, "cash", team, start) for i, ts, d, p, doc, k, team, start in requests],
        "request_id int, request_ts timestamp_ntz, p_id int, doc_id int, surgery_name string, surgery_date date, payment_method string, stuff_id int, start_time int",
    )
    result = surgery.schedule_surgery(
        df if mode == "manual" else df.drop("start_time"),
        people,
        frame(spark, [(k, f"OP{k}", v, Decimal(100 * k)) for k, v in kinds.items()], "surgery_id int, surgery_name string, duration int, price decimal(10,2)"),
        frame(spark, [(i, k, Decimal(7)) for i, k in room], "room_id int, room_type string, price_per_day decimal(10,2)"),
        frame(spark, [(t,) for t in (1, 2, 3)], "stuff_id int"),
        table(spark, "surgery_reservation", [dict(zip(("reservation_id", "surgery_date", "start_time", "end_time", "paid_money", "p_id", "surgery_id", "room_id", "stuff_id", "doctor_id", "receptionist_id", "status"), s)) for s in surgeries]),
        frame(spark, stays, "reservation_id int, checkin date, checkout date, room_id int"),
        emp_shift, dated, table(spark, "invoice", []), mode=mode,
    )
    expected = surgery_loop(requests, kinds, [1, 2], [3, 4], [1, 2, 3], existing, loads, mode)
    got = messages(result)
    placed = {}
    for r in result.tables["surgery_reservation"].collect():
        placed[r.reservation_id] = (r.room_id, r.start_time, r.end_time, r.stuff_id)
    ids = {r.request_id: r.reservation_id for r in result.outcomes.collect() if r.accepted}
    for rid, want in expected.items():
        if isinstance(want, str):
            assert got[rid] == want
        else:
            assert placed[ids[rid]] == (want[0], want[2], want[3], want[4])
            assert f"OR Room: {want[0]}, Recovery Room: {want[1]}." in got[rid]
    accepted = [r for r in sorted(requests, key=lambda r: (r[1], r[0])) if not isinstance(expected[r[0]], str)]
    assert [ids[r[0]] for r in accepted] == list(range(103, 103 + len(accepted)))
    assert result.tables["invoice_details"].count() == 3 * len(accepted) == 1.5 * result.tables["room_reservation"].count()


def test_surgery_guards(spark):
    people, emp_shift, dated = desk(spark)
    people = people.unionByName(staff(spark, (1, "consultant_doctor", "active", 1, 1), (2, "doctor", "active", 1, 1)))
    today = TS(2024, 1, 10, 12)
    asked = [
        (1, today, 2, "op", D(2024, 1, 15)), (2, today, 1, "op", D(2024, 1, 10)), (3, today, 1, "op", D(2024, 1, 12)),
        (4, today, 1, "zz", D(2024, 1, 15)), (5, TS(2024, 1, 10, 0, 0, 0), 1, "op", D(2024, 1, 15)),
    ]
    def run(mode):
        return messages(surgery.schedule_surgery(
            frame(spark, [(i, ts, 7, d, n, day, "cash", 1, None) for i, ts, d, n, day in asked], "request_id int, request_ts timestamp_ntz, p_id int, doc_id int, surgery_name string, surgery_date date, payment_method string, stuff_id int, start_time int"),
            people, frame(spark, [(1, "OP", 30, Decimal(1))], "surgery_id int, surgery_name string, duration int, price decimal(10,2)"),
            frame(spark, [(1, "surgery", Decimal(7))], "room_id int, room_type string, price_per_day decimal(10,2)"),
            frame(spark, [(1,)], "stuff_id int"), table(spark, "surgery_reservation", []),
            frame(spark, [], "reservation_id int, checkin date, checkout date, room_id int"), emp_shift, dated, table(spark, "invoice", []), mode=mode,
        ))
    said = run("auto")
    assert said[1].startswith("? The selected doctor") and said[2] == "? Cannot schedule surgery in the past."
    assert said[3].startswith("? Cannot schedule surgery on Friday") and said[4] == "? Surgery not found." and said[5] == "? No receptionist available now."
    manual = run("manual")
    assert manual[2] == manual[3] == surgery.NO_RECOVERY
    assert messages(
        surgery.schedule_surgery(
            frame(spark, [(1, today, 7, 1, "op", D(2024, 1, 15), "cash", None, 30000)], "request_id int, request_ts timestamp_ntz, p_id int, doc_id int, surgery_name string, surgery_date date, payment_method string, stuff_id int, start_time int"),
            people, frame(spark, [(1, "OP", 30, Decimal(1))], "surgery_id int, surgery_name string, duration int, price decimal(10,2)"),
            frame(spark, [(1, "surgery", Decimal(7))], "room_id int, room_type string, price_per_day decimal(10,2)"),
            frame(spark, [(1,)], "stuff_id int"), table(spark, "surgery_reservation", []),
            frame(spark, [], "reservation_id int, checkin date, checkout date, room_id int"), emp_shift, dated, table(spark, "invoice", []), mode="manual",
        )
    ) == {1: surgery.NO_TEAM}


@pytest.mark.parametrize("wrap", [False, True])
def test_surgeries_over_midnight(spark, wrap):
    people, emp_shift, dated = desk(spark)
    people = people.unionByName(staff(spark, (1, "consultant_doctor", "active", 1, 1)))
    result = surgery.schedule_surgery(
        frame(spark, [(1, NOON, 7, 1, "op", D(2024, 1, 15), "cash", 1, 84600), (2, NOON, 8, 1, "op", D(2024, 1, 16), "cash", 1, 82800)], "request_id int, request_ts timestamp_ntz, p_id int, doc_id int, surgery_name string, surgery_date date, payment_method string, stuff_id int, start_time int"),
        people, frame(spark, [(1, "OP", 60, Decimal(1))], "surgery_id int, surgery_name string, duration int, price decimal(10,2)"),
        frame(spark, [(1, "surgery", Decimal(7)), (2, "recovery", Decimal(7))], "room_id int, room_type string, price_per_day decimal(10,2)"),
        frame(spark, [(1,)], "stuff_id int"), table(spark, "surgery_reservation", []),
        frame(spark, [], "reservation_id int, checkin date, checkout date, room_id int"), emp_shift, dated, table(spark, "invoice", []),
        mode="manual", wrap_midnight=wrap,
    )
    placed = {r.surgery_date: (r.start_time, r.end_time) for r in result.tables["surgery_reservation"].collect()}
    if wrap:
        assert placed == {D(2024, 1, 15): (84600, 1800), D(2024, 1, 16): (82800, 0)}
    else:
        assert D(2024, 1, 15) not in placed and messages(result)[1] == surgery.NO_ROOM


def test_cancel_hits_other_kinds_only_with_compat(spark):
    surgeries = table(spark, "surgery_reservation", [dict(reservation_id=5, surgery_date=D(2024, 1, 15), start_time=25200, end_time=30000, paid_money=Decimal(9), p_id=1, surgery_id=1, room_id=1, stuff_id=1, status="scheduled")])
    stays = table(spark, "room_reservation", [dict(reservation_id=i, paid_money=Decimal(3), checkin=d, p_id=1, room_id=i, emp_id=1, status=s) for i, d, s in ((1, D(2024, 1, 15), "reserved_for_surgery"), (2, D(2024, 1, 15), "reserved_for_recovery"), (3, D(2024, 1, 14), "reserved_for_surgery"), (4, D(2024, 1, 16), "other"))])
    status = table(spark, "room_status", [dict(room_id=i, status="reserved") for i in range(1, 5)])
    invoice = table(spark, "invoice", [dict(invoice_id=i, date=D(2024, 1, 1), payment_method="x", p_id=1, emp_id=1) for i in (1, 2, 3)])
    details = table(spark, "invoice_details", [dict(invoice_details_id=i, invoice_id=v, reservation_id=r, reservation_type=k, process_id=1) for i, v, r, k in ((1, 1, 5, "Surgery"), (2, 2, 5, "Clinic"))])
    asked = frame(spark, [(1, NOON, 5), (2, NOON, 6)], "request_id int, request_ts timestamp_ntz, reservation_id int")
    for compat, left in ((True, []), (False, [(2,)])):
        result = surgery.cancel_surgery(asked, surgeries, stays, status, invoice, details, compat=compat)
        assert rows(result.tables["invoice"], "invoice_id") == left
    assert messages(result)[2] == "❌ Reservation not found."
    assert rows(result.tables["room_reservation"], "reservation_id", "status") == [(1, "canceled"), (2, "canceled"), (3, "reserved_for_surgery"), (4, "other")]
    assert rows(result.tables["room_status"]) == [(1, "available"), (2, "available"), (3, "reserved"), (4, "reserved")]
    untouched = surgery.cancel_surgery(asked.filter("request_id = 2"), surgeries, stays, status, invoice, details)
    assert untouched.tables["invoice"].count() == 3


@pytest.mark.parametrize("refuse", [False, True])
def test_rewards_of_inactive_employees(spark, refuse):
    people = staff(spark, (1, "doctor", "Active", 100, 1), (2, "doctor", "Inactive", 100, 1))
    asked = frame(
        spark,
        [(1, 1, "bonus", None, Decimal(5)), (2, 2, "bonus", None, Decimal(5)), (3, 9, "bonus", None, Decimal(5)), (4, 2, "bonus", None, Decimal(0)), (5, 1, "bonus", None, Decimal(0))],
        "request_id long, emp_id int, type string, date date, amount decimal(10,2)",
    )
    done = attendance.add_reward(asked, people, table(spark, "reward", []), moment(NOON), refuse_inactive=refuse)
    inactive, zero = "Employee is inactive and cannot add reward", "Reward amount must be greater than zero"
    assert messages(done) == {
        1: "Reward added successfully",
        2: inactive if refuse else "Reward added successfully",
        3: "Employee not found",
        4: inactive if refuse else zero,
        5: zero,
    }
    assert rows(done.tables["inserted"], "emp_id") == ([(1,)] if refuse else [(1,), (2,)])


def test_recovery_loads_name_every_room_on_every_date(spark):
    room = frame(spark, [(1, "recovery"), (2, "Recovery"), (3, "surgery")], "room_id long, room_type string")
    stays = frame(spark, [(1, D(2024, 1, 1), D(2024, 1, 2)), (3, D(2024, 1, 1), D(2024, 1, 9))], "room_id long, checkin date, checkout date")
    dates = frame(spark, [(D(2024, 1, 2),), (D(2024, 1, 5),), (D(2024, 1, 5),)], "surgery_date date")
    got = surgery.recovery_loads_everywhere(dates, room, stays).collect()
    assert sorted(tuple(r) for r in got) == [(D(2024, 1, 2), 1, 1), (D(2024, 1, 2), 2, 0), (D(2024, 1, 5), 1, 0), (D(2024, 1, 5), 2, 0)]
