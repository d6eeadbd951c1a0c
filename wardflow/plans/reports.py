"""Read-only reports over the hospital tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.clock import month_key
from wardflow.functions.money import line_total
from wardflow.functions.text import full_name, same_text


def patient_basic_info(patient: DataFrame) -> DataFrame:
    return patient.select(
        "p_id", full_name("fname", "lname").alias("full_name"), "email", "phone", "gender", "birth_date", "ssn"
    )


def doctor_schedule(weekly: DataFrame, employee: DataFrame, department: DataFrame) -> DataFrame:
    """One row per weekly slot with the doctor's name and the slot's department."""
    doctors = employee.select("emp_id", full_name("fname", "lname").alias("doctor_name"))
    return (
        weekly.join(doctors, "emp_id")
        .join(department.select("dept_id", "dept_name"), "dept_id")
        .select(
            F.col("id").alias("doctor_appointment_id"),
            F.col("emp_id").alias("doctor_id"),
            "doctor_name",
            "day",
            "shift_start",
            "shift_end",
            "examination_price",
            "dept_id",
            "dept_name",
        )
    )


def _role(employee: DataFrame, role: str) -> DataFrame:
    return employee.select(
        F.col("emp_id").alias(f"{role}_id"), full_name("fname", "lname").alias(f"{role}_name")
    )


def reservations_full(
    reservation: DataFrame, patient: DataFrame, employee: DataFrame, department: DataFrame
) -> DataFrame:
    """Reservations with all names; a missing receptionist drops the row."""
    people = patient.select("p_id", full_name("fname", "lname").alias("patient_name"))
    return (
        reservation.join(people, "p_id")
        .join(_role(employee, "doctor"), "doctor_id")
        .join(_role(employee, "receptionist"), "receptionist_id")
        .join(department.select("dept_id", "dept_name"), "dept_id")
        .select(
            "reservation_id", "date_time", "patient_name", "doctor_name", "receptionist_name", "dept_name", "paid_money"
        )
    )


def invoices_full(
    invoice: DataFrame, details: DataFrame, patient: DataFrame, employee: DataFrame
) -> DataFrame:
    """One row per invoice line, with the header and both names."""
    people = patient.select("p_id", full_name("fname", "lname").alias("patient_name"))
    issuers = employee.select("emp_id", full_name("fname", "lname").alias("employee_name"))
    return (
        details.select("invoice_id", "reservation_id", "reservation_type")
        .join(invoice, "invoice_id")
        .join(people, "p_id")
        .join(issuers, "emp_id")
        .select(
            "invoice_id",
            "reservation_id",
            "reservation_type",
            "date",
            "payment_method",
            "paid_money",
            "patient_name",
            "employee_name",
        )
    )


def revenue_by_department(invoice: DataFrame, employee: DataFrame, department: DataFrame) -> DataFrame:
    """Invoice totals by the issuing employee's department name.

    Invoices are summed per issuer first, so only one row per issuer is joined.
    """
    per_issuer = invoice.groupBy("emp_id").agg(F.sum("paid_money").alias("paid"))
    return (
        per_issuer.join(employee.select("emp_id", "dept_id"), "emp_id")
        .groupBy("dept_id")
        .agg(F.sum("paid").alias("paid"))
        .join(department.select("dept_id", "dept_name"), "dept_id")
        .groupBy("dept_name")
        .agg(F.sum("paid").alias("total_revenue"))
    )


def top_doctors(
    employee: DataFrame,
    department: DataFrame,
    reservation: DataFrame,
    invoice: DataFrame,
    details: DataFrame,
    n: int = 5,
) -> DataFrame:
    """Doctors with the most billed appointments and the money invoiced for them.

    Clinic lines lead from a reservation to its invoice. Lines are reduced to one
    row per (reservation, invoice) before the join, so that several lines do not
    inflate the count; ties go to the lowest id.
    """
    billed = (
        details.filter(same_text("reservation_type", "clinic"))
        .select("reservation_id", "invoice_id")
        .distinct()
        .join(invoice.select("invoice_id", "paid_money"), "invoice_id")
    )
    per_doctor = (
        reservation.select("reservation_id", F.col("doctor_id").alias("emp_id"))
        .join(billed, "reservation_id")
        .groupBy("emp_id")
        .agg(F.count("reservation_id").alias("total_appointments"), F.sum("paid_money").alias("total_revenue"))
    )
    doctors = employee.filter(same_text("type", "doctor")).select(
        "emp_id", full_name("fname", "lname").alias("doctor_name"), "dept_id"
    )
    return (
        per_doctor.join(doctors, "emp_id")
        .join(department.select("dept_id", "dept_name"), "dept_id")
        .select("emp_id", "doctor_name", "dept_name", "total_appointments", "total_revenue")
        .orderBy(F.desc("total_appointments"), "emp_id")
        .limit(n)
    )


def monthly_new_patients(reservation: DataFrame, n: int = 5) -> DataFrame:
    """Months with the most distinct patients; ties go to the earlier month."""
    return (
        reservation.groupBy(month_key("date_time").alias("month"))
        .agg(F.countDistinct("p_id").alias("new_patients"))
        .orderBy(F.desc("new_patients"), "month")
        .limit(n)
    )


# Size of a month's sketch, as a power of two: 4096 registers, a standard error of 1.6 %.
SKETCH_LG_K = 12


def patient_month_sketches(reservation: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """One mergeable sketch of the distinct patients of each month: a few KB, whatever the month's rows are."""
    return reservation.groupBy(month_key("date_time").alias("month")).agg(
        F.hll_sketch_agg(F.col("p_id").cast("long"), lg_k).alias("patients")
    )


def merge_month_sketches(sketches: DataFrame, more: DataFrame) -> DataFrame:
    """Sketches of all rows behind both; a patient seen in both counts once. Older reservations are not read again."""
    return sketches.unionByName(more).groupBy("month").agg(F.hll_union_agg("patients").alias("patients"))


def monthly_new_patients_estimate(sketches: DataFrame, n: int | None = 5) -> DataFrame:
    """``monthly_new_patients`` from sketches: the opt-in for months with too many patients to count apart.

    Without ``n`` all months are returned.
    """
    ranked = sketches.select("month", F.hll_sketch_estimate("patients").alias("new_patients"))
    ranked = ranked.orderBy(F.desc("new_patients"), "month")
    return ranked if n is None else ranked.limit(n)


def expiry_alert(drugs: DataFrame, as_of: Column, months: int = 3) -> DataFrame:
    """Drugs that expire from ``as_of`` on, up to ``months`` calendar months ahead.

    The expiry date counts as midnight, so a drug expiring today is listed only when
    ``as_of`` is midnight itself.
    """
    last = F.add_months(as_of.cast("date"), months)
    first = F.when(as_of == F.date_trunc("DAY", as_of), as_of.cast("date")).otherwise(
        F.date_add(as_of.cast("date"), 1)
    )
    return (
        drugs.filter((F.col("exp_date") >= first) & (F.col("exp_date") <= last))
        .select(
            "drug_id",
            "drug_name",
            "quantity",
            "exp_date",
            F.datediff("exp_date", as_of.cast("date")).alias("days_to_expire"),
        )
        .orderBy("exp_date", "drug_id")
    )


def invoice_line_totals(details: DataFrame) -> DataFrame:
    return details.withColumn("total", line_total("unit_price", "quantity"))


def service_names(lab_tests: DataFrame, radiology: DataFrame) -> DataFrame:
    """Distinct names of everything that can be ordered."""
    return (
        lab_tests.select(F.col("test_name").alias("service_name"))
        .union(radiology.select(F.col("rad_name")))
        .distinct()
    )


def reward_deduction_staging(reward: DataFrame, deduction: DataFrame) -> DataFrame:
    """Rewards and deductions in one set, told apart by ``rd_type``."""
    from wardflow.operators.snapshots import tagged_union

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("emp_id", "amount", F.col("date").alias("rd_date"))

    return tagged_union({"Reward": shaped(reward), "Deduction": shaped(deduction)}, "rd_type")
