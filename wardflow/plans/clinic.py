"""Patients, doctor bookings, diagnoses and prescriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.money import money
from wardflow.functions.text import folded, joined
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, first_per, flagged, within_batch
from wardflow.operators.scan import with_next_ids
from wardflow.operators.snapshots import append
from wardflow.plans.duty import with_doctor, with_receptionist
from wardflow.session import materialize

DAILY_CAP = 20


def get_or_add_patients(requests: DataFrame, patient: DataFrame) -> JobResult:
    """Id of the patient with that ssn; the first request of an unknown ssn adds them."""
    known = patient.filter("ssn is not null").groupBy(folded("ssn").alias("_ssn")).agg(F.min("p_id").alias("_old"))
    asked = requests.drop("p_id").withColumn("_ssn", folded("ssn")).join(known, "_ssn", "left")
    new = asked.filter("_old is null")
    firsts = first_per(new.filter("_ssn is not null"), ["_ssn"]).select("request_id")
    winners = new.join(firsts.withColumn("_won", F.lit(True)), "request_id", "left").filter(
        F.coalesce("_won", F.lit(False)) | F.col("_ssn").isNull()
    )
    added = with_next_ids(winners.drop("_won"), patient, "p_id", REQUEST_ORDER)
    by_id = added.select("request_id", F.col("p_id").alias("_added"))
    by_ssn = added.filter("_ssn is not null").select("_ssn", F.col("p_id").alias("_shared"))
    outcomes = (
        asked.join(by_id, "request_id", "left")
        .join(by_ssn, "_ssn", "left")
        .select(
            "request_id",
            F.col("_added").isNotNull().alias("accepted"),
            F.when(F.col("_added").isNotNull(), "Patient inserted successfully.")
            .otherwise("Patient already exists. Returned existing p_id.")
            .alias("message"),
            F.coalesce("_old", "_added", "_shared").cast("long").alias("p_id"),
        )
    )
    return JobResult(outcomes, {"patient": append(patient, added)})


def update_patient_contact(requests: DataFrame, patient: DataFrame) -> JobResult:
    """Partial update of email and phone by ssn: the last given value of each counts."""
    known = patient.filter("ssn is not null").select(folded("ssn").alias("_ssn")).distinct()
    asked = flagged(requests.withColumn("_ssn", folded("ssn")), known, ["_ssn"], "found")
    outcomes = asked.select(
        "request_id",
        F.col("found").alias("accepted"),
        F.when(F.col("found"), "Patient email and phone updated successfully.")
        .otherwise("Patient with provided SSN not found.")
        .alias("message"),
    )

    def last_given(column: str) -> Column:
        return F.max(F.when(F.col(column).isNotNull(), F.struct(*REQUEST_ORDER, column)))[column]

    latest = (
        asked.filter("found")
        .groupBy("_ssn")
        .agg(last_given("email").alias("_email"), last_given("phone").alias("_phone"))
    )
    changed = (
        patient.withColumn("_ssn", folded("ssn"))
        .join(latest, "_ssn", "left")
        .withColumns({"email": F.coalesce("_email", "email"), "phone": F.coalesce("_phone", "phone")})
        .select(*patient.columns)
    )
    return JobResult(outcomes, {"patient": changed})


def book_doctor(
    requests: DataFrame,
    weekly: DataFrame,
    employee: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    reservations: DataFrame,
    invoice: DataFrame,
    cap: int = DAILY_CAP,
) -> JobResult:
    """Book the doctor on duty in the department, up to ``cap`` bookings per doctor and day.

    ``request_ts`` is the moment of the call. When the chosen doctor is full the
    request is refused; no other doctor is tried.
    """
    with_doctors = weekly.select("dept_id").distinct().withColumn("staffed", F.lit(True))
    # Stored bookings of the batch's days only: the bounds reach the scan.
    near = within_batch(reservations, F.to_date("date_time"), requests, F.to_date("request_ts"))
    booked = (
        near.groupBy("doctor_id", F.to_date("date_time").alias("day"))
        .agg(F.count("*").alias("booked"))
    )
    asked = with_receptionist(
        with_doctor(requests.join(with_doctors, "dept_id", "left"), weekly),
        employee,
        emp_shift,
        dated,
        today_only=True,
    )
    asked = asked.withColumns(
        {
            "doctor_id": F.col("duty_doctor.emp_id"),
            "price": money(F.col("duty_doctor.examination_price")),
            "day": F.to_date("request_ts"),
        }
    ).withColumn(
        "refused",
        first_failure(
            [
                (F.col("staffed").isNull(), "❌ This department has no registered doctors."),
                (F.col("doctor_id").isNull(), "❌ No doctors available now for this department."),
                (F.col("receptionist_id").isNull(), "❌ No receptionist available now."),
            ]
        ),
    )
    asked = materialize(asked.drop("duty_doctor"), "asked")
    # The row limit goes ahead of the shuffle, so a crowded doctor-day sends at most
    # `cap` rows per task.
    line = Window.partitionBy("doctor_id", "day").orderBy(*REQUEST_ORDER)
    first_in_line = (
        asked.filter("refused is null")
        .select("doctor_id", "day", "p_id", "dept_id", "payment_method", "receptionist_id", "price", *REQUEST_ORDER)
        .withColumn("place", F.row_number().over(line))
        .filter(F.col("place") <= cap)
    )
    accepted = first_in_line.join(booked, ["doctor_id", "day"], "left").filter(
        F.col("place") <= cap - F.coalesce("booked", F.lit(0))
    )
    made = with_next_ids(accepted.drop("place", "booked"), reservations, "reservation_id", REQUEST_ORDER)
    made = made.withColumn(
        "invoice_id",
        F.col("reservation_id")
        - reservations.agg(F.coalesce(F.max("reservation_id"), F.lit(0))).scalar()
        + invoice.agg(F.coalesce(F.max("invoice_id"), F.lit(0))).scalar(),
    )
    outcomes = asked.join(
        made.select("request_id", "reservation_id", "invoice_id"), "request_id", "left"
    ).select(
        "request_id",
        F.col("reservation_id").isNotNull().alias("accepted"),
        F.when(
            F.col("reservation_id").isNotNull(),
            joined(
                F.lit("✔ Reservation completed successfully. Reservation ID = "),
                "reservation_id",
                F.lit(", Assigned Doctor ID = "),
                "doctor_id",
            ),
        )
        .otherwise(F.coalesce("refused", F.lit("❌ Maximum daily reservations reached for this doctor.")))
        .alias("message"),
        "reservation_id",
        "invoice_id",
    )
    rows = made.select(
        "reservation_id",
        F.col("request_ts").alias("date_time"),
        F.col("price").alias("paid_money"),
        "p_id",
        "dept_id",
        "doctor_id",
        "receptionist_id",
    )
    headers = made.select(
        "invoice_id",
        F.to_date("request_ts").alias("date"),
        "payment_method",
        F.col("price").alias("paid_money"),
        "p_id",
        F.col("receptionist_id").alias("emp_id"),
    )
    lines = made.select(
        "invoice_id",
        "reservation_id",
        F.lit("Clinic").alias("reservation_type"),
        F.col("doctor_id").alias("process_id"),
        F.col("price").alias("unit_price"),
        F.lit(1).alias("quantity"),
        F.col("price").alias("total"),
        "dept_id",
    )
    return JobResult(outcomes, {"reservations": rows, "invoice": headers, "invoice_details": lines})


def add_diagnoses(requests: DataFrame, reservations: DataFrame, diagnoses: DataFrame) -> JobResult:
    """Diagnoses by reservation; patient and doctor come from the reservation."""
    source = reservations.select("reservation_id", "p_id", F.col("doctor_id").alias("emp_id"))
    asked = requests.join(source, "reservation_id", "left")
    rows = with_next_ids(asked.filter("p_id is not null"), diagnoses, "dig_id", REQUEST_ORDER)
    outcomes = asked.select("request_id", "p_id").join(rows.select("request_id", "dig_id"), "request_id", "left").select(
        "request_id",
        F.col("dig_id").isNotNull().alias("accepted"),
        F.when(F.col("dig_id").isNotNull(), "Diagnosis inserted successfully.")
        .otherwise("Invalid reservation_id.")
        .alias("message"),
        "dig_id",
    )
    return JobResult(outcomes, {"diagnose_history": rows.select("dig_id", "dig_description", "p_id", "emp_id")})


def add_prescriptions(requests: DataFrame, reservations: DataFrame, prescriptions: DataFrame) -> JobResult:
    """At most one prescription per reservation."""
    source = reservations.select("reservation_id", "p_id")
    done = prescriptions.filter("reservation_id is not null").select("reservation_id").distinct()
    asked = flagged(requests.join(source, "reservation_id", "left"), done, ["reservation_id"], "prescribed")
    refused = first_failure(
        [
            (F.col("p_id").isNull(), "Invalid reservation id."),
            (F.col("prescribed"), " This reservation already have a prescription "),
        ]
    )
    asked = asked.withColumn("refused", refused)
    firsts = first_per(asked.filter("refused is null"), ["reservation_id"], "p_id", "notes", "drug_name")
    rows = with_next_ids(firsts, prescriptions, "prescription_id", REQUEST_ORDER)
    outcomes = asked.join(rows.select("request_id", "prescription_id"), "request_id", "left").select(
        "request_id",
        F.col("prescription_id").isNotNull().alias("accepted"),
        F.when(
            F.col("prescription_id").isNotNull(),
            joined(F.lit("Prescription added successfully. Prescription ID = "), "prescription_id"),
        )
        .otherwise(F.coalesce("refused", F.lit(" This reservation already have a prescription ")))
        .alias("message"),
        "prescription_id",
    )
    added = rows.select(
        "prescription_id", F.to_date("request_ts").alias("date"), "notes", "p_id", "reservation_id", "drug_name"
    )
    return JobResult(outcomes, {"prescription": added})
