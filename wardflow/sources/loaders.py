"""Readers for the seed files and small inline tables, and the snapshot writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions.clock import clock_seconds
from wardflow.schemas import table_schema

# Expense types and surgical teams every installation starts with.
EXPENSE_TYPES = ("gas", "water", "electricity", "internet", "lab_tools", "rad_tools", "room_tools", "Pharmacy")
TEAM_COUNT = 6

# Columns of the seed files in file order. Dates are ISO, times H:mm, unless said otherwise.
LAYOUTS: dict[str, tuple[str, Sequence[str]]] = {
    "patient": ("patient", ("p_id", "fname", "lname", "email", "birth_date", "gender", "phone", "ssn")),
    "department": ("department", ("dept_id", "dept_name", "manager_id")),
    "doctor_appointments": (
        "doctor_appointments",
        ("id", "examination_price", "day", "shift_start", "shift_end", "emp_id", "dept_id"),
    ),
    "shift_appointment": ("shift_appointment", ("shift_id", "shift_type", "date", "start_time", "end_time")),
    "emp_shift": ("emp_shift", ("emp_id", "shift_id")),
    "pharmacy_drugs": (
        "pharmacy_drugs",
        ("drug_id", "drug_name", "barcode", "quantity", "exp_date", "prod_date", "price"),
    ),
    "lab_tests": ("lab_tests", ("test_id", "test_name", "delivery_duration", "price")),
    "radiology": ("radiology", ("rad_id", "rad_name", "delivery_duration", "price")),
    "room": ("room", ("room_id", "room_type", "price_per_day")),
    "surgery": ("surgery", ("surgery_id", "surgery_name", "duration", "price")),
}

# The two layouts in which employees are delivered.
EMPLOYEE_LAYOUTS: dict[str, Sequence[str]] = {
    "plain": (
        "emp_id", "fname", "lname", "email", "birth_date", "gender", "phone", "ssn", "type", "start_job", "status",
        "salary", "dept_id",
    ),
    "merged": (
        "emp_id", "fname", "lname", "email", "birth_date", "gender", "phone", "ssn", "salary", "type", "dept_id",
        "start_job", "status",
    ),
}

_TIME_COLUMNS = {"shift_start", "shift_end", "start_time", "end_time"}


def _text_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless CSV as text columns; numbers such as phones keep their leading zeros."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", False).option("ignoreLeadingWhiteSpace", True).csv(path)


def _typed(name: str, kind: T.DataType, date_format: str) -> Column:
    value = F.trim(F.col(name))
    if name in _TIME_COLUMNS:
        return clock_seconds(value).alias(name)
    if isinstance(kind, T.DateType):
        return F.to_date(value, date_format).alias(name)
    return value.cast(kind).alias(name)


def read_table(spark: SparkSession, path: str, layout: str, duration_unit: str = "minutes") -> DataFrame:
    """A seed file in one of ``LAYOUTS``.

    ``duration_unit="hours"`` turns the surgery durations of a file into minutes.
    """
    table, columns = LAYOUTS[layout]
    schema = table_schema(table)
    rows = _text_rows(spark, path, columns)
    typed = rows.select(*[_typed(c, schema[c].dataType, "yyyy-M-d") for c in columns])
    if layout == "surgery" and duration_unit == "hours":
        typed = typed.withColumn("duration", F.col("duration") * 60)
    return typed


def read_employees(spark: SparkSession, path: str, layout: str = "plain") -> DataFrame:
    """Employees with dd/MM/yyyy dates; lines without a numeric id are dropped."""
    columns = EMPLOYEE_LAYOUTS[layout]
    schema = table_schema("employee")
    rows = _text_rows(spark, path, columns).filter(F.col("emp_id").rlike(r"^\s*\d+\s*$") & F.col("fname").isNotNull())
    typed = rows.select(*[_typed(c, schema[c].dataType, "d/M/yyyy") for c in columns])
    return typed.withColumn("end_job", F.lit(None).cast("date")).select(*[f.name for f in schema])


def read_codes(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A small code list; whether it is broadcast is left to its measured size."""
    return read_table(spark, path, layout)


def inline_rows(spark: SparkSession, rows: Sequence[tuple], table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A handful of literal rows in the layout of a table."""
    schema = table_schema(table)
    names = list(columns or [f.name for f in schema])
    fields = T.StructType([schema[name] for name in names])
    return spark.createDataFrame(list(rows), fields)


def expense_types(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, list(enumerate(EXPENSE_TYPES, start=1)), "expenses_type")


def surgery_teams(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, [(n, f"Surgery Team {n}") for n in range(1, TEAM_COUNT + 1)], "stuff")


def read_snapshot(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(table_schema(table)).parquet(f"{folder}/{table}")


def write_snapshot(df: DataFrame, folder: str, table: str, partition_by: str | None = None) -> None:
    """Write one table of a new snapshot folder; an existing table is never overwritten."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{folder}/{table}")


def append_rows(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{table}")
