"""Hospital tables read out of the order-processing test tables.

``Roles`` gives each hospital table as a DataFrame; ``SQL`` holds the same
definitions as common table expressions for the SQL checks.
"""

from __future__ import annotations

from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardflow.functions.money import money
from wardflow.session import materialize

# English weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Dated shifts as (shift_id, shift_type, start, end) in seconds of the day.
SHIFTS = ((1, "morning", 43200, 0), (2, "evening", 0, 43200), (3, "day", 28800, 72000))


class Roles:
    """Hospital tables over one folder of Parquet test tables."""

    # Layouts already read from a file's footer, by path.
    _layouts: ClassVar[dict[str, StructType]] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in self._layouts:
            self._layouts[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._layouts[path]).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("request_ts"),
            (F.col("user_id") * 12).alias("emp_id"),
            "event_type",
            money("value", 18).alias("amount"),
        )

    @cached_property
    def employee(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        kind = (
            F.when(segment == "MACHINERY", "Doctor")
            .when(segment == "BUILDING", "doctor")
            .when(segment == "AUTOMOBILE", "consultant_doctor")
            .when(segment == "FURNITURE", "Receptionist")
            .otherwise("nurse")
        )
        number = F.col("c_custkey").cast("string")
        return self.table("customer").select(
            F.col("c_custkey").alias("emp_id"),
            F.col("c_name").alias("fname"),
            segment.alias("lname"),
            F.concat(F.lit("mail"), number, F.lit("@ward.test")).alias("email"),
            F.concat(F.lit("010"), number).alias("phone"),
            F.concat(F.lit("S"), number).alias("ssn"),
            F.lit("Female").alias("gender"),
            F.lit("1980-01-01").cast("date").alias("birth_date"),
            money(F.abs("c_acctbal")).alias("salary"),
            kind.alias("type"),
            F.col("c_nationkey").alias("dept_id"),
            F.lit("2020-01-01").cast("date").alias("start_job"),
            F.lit(None).cast("date").alias("end_job"),
            F.when(F.col("c_acctbal") < 0, "Inactive").otherwise("active").alias("status"),
        )

    @cached_property
    def patient(self) -> DataFrame:
        """Customers in credit; the others are strangers to the hospital."""
        number = F.col("c_custkey").cast("string")
        return self.table("customer").filter("c_acctbal >= 0").select(
            F.col("c_custkey").alias("p_id"),
            F.col("c_name").alias("fname"),
            F.col("c_mktsegment").alias("lname"),
            F.concat(F.lit("mail"), number, F.lit("@ward.test")).alias("email"),
            F.lit("1980-01-01").cast("date").alias("birth_date"),
            F.lit("Female").alias("gender"),
            F.concat(F.lit("010"), number).alias("phone"),
            F.concat(F.lit("S"), number).alias("ssn"),
        )

    @cached_property
    def department(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("dept_id"),
            F.col("n_name").alias("dept_name"),
            (F.col("n_nationkey") * 3 + 1).cast("long").alias("manager_id"),
        )

    @cached_property
    def attendance(self) -> DataFrame:
        """Per employee and day: first and last event; a single event leaves the day open."""
        return self._days(self.events)

    @cached_property
    def signups(self) -> DataFrame:
        """Attendance that is already on file when a batch of check-ins arrives."""
        return self._days(self.events.filter("event_type = 'signup'"))

    @staticmethod
    def _days(events: DataFrame) -> DataFrame:
        return events.groupBy("emp_id", F.to_date("request_ts").alias("attend_date")).agg(
            F.min("request_ts").alias("checkin"),
            F.when(F.count("*") > 1, F.max("request_ts")).alias("checkout"),
        )

    def _amounts(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == kind).select(
            "emp_id", F.col("event_type").alias("type"), F.to_date("request_ts").alias("date"), "amount"
        )

    @cached_property
    def reward(self) -> DataFrame:
        return self._amounts("purchase")

    @cached_property
    def deduction(self) -> DataFrame:
        return self._amounts("error")

    @cached_property
    def weekly(self) -> DataFrame:
        """Seven weekly slots per doctor: by day for even ids, evenings for odd ones."""
        doctors = self.employee.filter(F.lower("type") == "doctor").select("emp_id", "dept_id")
        days = F.posexplode(F.array(*[F.lit(d) for d in WEEKDAYS]))
        early = F.col("emp_id") % 2 == 0
        return doctors.select("*", days.alias("_n", "day")).select(
            (F.col("emp_id") * 7 + F.col("_n")).alias("id"),
            (F.lit(200) + F.col("dept_id") * 50).alias("examination_price"),
            "day",
            F.when(early, 32400).otherwise(61200).alias("shift_start"),
            F.when(early, 57600).otherwise(0).alias("shift_end"),
            "emp_id",
            "dept_id",
        )

    @cached_property
    def dated(self) -> DataFrame:
        """Three shifts on every date with events."""
        return self._shifts(self.table("events").select(F.to_date("ts").alias("date")).distinct())

    @cached_property
    def order_shifts(self) -> DataFrame:
        """Three shifts on every order date."""
        return self._shifts(self.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct())

    @staticmethod
    def _shifts(dates: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(
                    F.lit(i).alias("shift_id"),
                    F.lit(kind).alias("shift_type"),
                    F.lit(start).alias("start_time"),
                    F.lit(end).alias("end_time"),
                )
                for i, kind, start, end in SHIFTS
            ]
        )
        return dates.select("date", F.explode(entries).alias("s")).select(
            "s.shift_id", "s.shift_type", "date", "s.start_time", "s.end_time"
        )

    @cached_property
    def emp_shift(self) -> DataFrame:
        """Nurses and receptionists work one of the three shifts."""
        staff = self.employee.filter(F.lower("type").isin("nurse", "receptionist"))
        return staff.select("emp_id", (F.col("emp_id") % 3 + 1).cast("int").alias("shift_id"))

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as requests: the clock time follows from the order number."""
        seconds = (F.col("o_orderkey") * 61 % 86400).cast("int")
        zero = F.lit(0)
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"),
            (F.col("o_orderdate") + F.make_dt_interval(zero, zero, zero, seconds)).alias("request_ts"),
            F.col("o_custkey").alias("p_id"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderstatus").alias("order_status"),
            F.to_date("o_orderdate").alias("order_date"),
            money("o_totalprice", 12).alias("paid"),
        )

    @cached_property
    def invoice(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("invoice_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderpriority").alias("payment_method"),
            money("o_totalprice", 12).alias("paid_money"),
            F.col("o_custkey").alias("p_id"),
            F.col("o_custkey").alias("emp_id"),
        )

    @cached_property
    def invoice_details(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_orderkey").alias("reservation_id"),
            F.when(flag == "A", "Clinic").when(flag == "N", "Pharmacy").otherwise("lab").alias("reservation_type"),
            F.col("l_suppkey").alias("process_id"),
            money("l_extendedprice", 12).alias("unit_price"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money("l_extendedprice", 12).alias("total"),
        )

    @cached_property
    def reservation(self) -> DataFrame:
        """Orders as appointments: the doctor follows from the customer."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("reservation_id"),
            F.col("o_orderdate").alias("date_time"),
            money("o_totalprice", 12).alias("paid_money"),
            F.col("o_custkey").alias("p_id"),
            (F.col("o_orderkey") % 25).cast("int").alias("dept_id"),
            F.col("o_custkey").alias("doctor_id"),
        )

    @cached_property
    def drugs(self) -> DataFrame:
        """Parts as drugs; names repeat from part 1500 on."""
        return self.table("part").select(
            F.col("p_partkey").alias("drug_id"),
            F.concat(F.lit("Drug "), (F.col("p_partkey") % 1500).cast("string")).alias("drug_name"),
            F.col("p_brand").alias("barcode"),
            F.col("p_size").alias("quantity"),
            F.lit("2030-01-01").cast("date").alias("exp_date"),
            F.lit("2020-01-01").cast("date").alias("prod_date"),
            money("p_retailprice").alias("price"),
        )

    @cached_property
    def exams(self) -> DataFrame:
        """Parts as examinations with unique names."""
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.lit("Exam "), F.col("p_partkey").cast("string")).alias("name"),
            F.col("p_size").alias("delivery_duration"),
            money("p_retailprice").alias("price"),
        )

    @cached_property
    def exam_lines(self) -> DataFrame:
        """Order lines as ordered examinations; taxed-most lines of the seventh kind name nothing known."""
        unknown = (F.col("l_linenumber") == 7) & (F.col("l_tax") >= 0.07)
        number = (F.col("l_partkey") % 150).cast("string")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("request_id"),
            F.when(unknown, "no such exam").otherwise(F.concat(F.lit("EXAM "), number)).alias("name"),
        )

    @cached_property
    def room(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("room_id"),
            F.col("p_type").alias("room_type"),
            money("p_retailprice").alias("price_per_day"),
        )

    @cached_property
    def room_status(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("room_id"),
            F.when(F.col("p_size") <= 10, "Available").otherwise("Reserved").alias("status"),
        )

    @cached_property
    def theatre(self) -> DataFrame:
        """Nations as a fixed set of 25 rooms: operating rooms, recovery rooms, wards."""
        key = F.col("n_nationkey")
        kind = F.when(key < 8, "surgery").when(key < 13, "Recovery").otherwise("normal")
        return self.table("nation").select(
            key.cast("long").alias("room_id"), kind.alias("room_type"), money(key * 100 + 500).alias("price_per_day")
        )

    @cached_property
    def surgery(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.alias("surgery_id"),
            F.col("n_name").alias("surgery_name"),
            (key * 10 + 30).alias("duration"),
            money(key * 1000 + 1000).alias("price"),
        )

    @cached_property
    def surgeries(self) -> DataFrame:
        """Order lines as surgeries, one per (order, line number)."""
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            *[F.min(c).alias(c) for c in ("l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")]
        )
        start = F.col("l_linenumber") * 1800 + 25200
        rows = lines.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("reservation_id"),
            F.to_date("l_shipdate").alias("surgery_date"),
            start.cast("int").alias("start_time"),
            (start + F.col("l_quantity") * 300).cast("int").alias("end_time"),
            money("l_extendedprice", 12).alias("paid_money"),
            F.col("l_orderkey").alias("p_id"),
            F.col("l_suppkey").alias("doctor_id"),
            (F.col("l_partkey") % 25).alias("room_id"),
            (F.col("l_partkey") % 6).alias("stuff_id"),
            F.lit("scheduled").alias("status"),
        )
        return materialize(rows, "surgeries")

    @cached_property
    def stays(self) -> DataFrame:
        """Room stays that belong to the surgeries, of one to three days."""
        return self.surgeries.select(
            "reservation_id",
            "paid_money",
            F.col("surgery_date").alias("checkin"),
            F.date_add("surgery_date", (F.col("reservation_id") % 3).cast("int")).alias("checkout"),
            "p_id",
            "room_id",
            F.when(F.col("stuff_id") < 2, "reserved_for_surgery")
            .when(F.col("stuff_id") < 4, "reserved_for_recovery")
            .otherwise("normal")
            .alias("status"),
        )


_WEEKDAY_ROWS = ", ".join(f"({n}, '{day}')" for n, day in enumerate(WEEKDAYS))
_SHIFT_ROWS = ", ".join(f"({i}, '{kind}', {start}, {end})" for i, kind, start, end in SHIFTS)

_DAYS = """
  SELECT emp_id, CAST(request_ts AS DATE) AS attend_date, min(request_ts) AS checkin,
         CASE WHEN count(*) > 1 THEN max(request_ts) END AS checkout
  FROM ev {where} GROUP BY ALL"""

# The same definitions for the SQL checks. Amounts are integer cents there.
SQL: dict[str, str] = {
    "ev": """
  SELECT event_id AS request_id, ts AS request_ts, user_id * 12 AS emp_id, event_type,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events""",
    "emp": """
  SELECT c_custkey AS emp_id, c_name AS fname, c_mktsegment AS lname,
         'mail' || c_custkey || '@ward.test' AS email, '010' || c_custkey AS phone, 'S' || c_custkey AS ssn,
         CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'Doctor' WHEN 'BUILDING' THEN 'doctor'
              WHEN 'AUTOMOBILE' THEN 'consultant_doctor' WHEN 'FURNITURE' THEN 'Receptionist' ELSE 'nurse' END AS type,
         c_nationkey AS dept_id, CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'active' END AS status
  FROM customer""",
    "pat": """
  SELECT c_custkey AS p_id, c_name AS fname, c_mktsegment AS lname,
         'mail' || c_custkey || '@ward.test' AS email, '010' || c_custkey AS phone, 'S' || c_custkey AS ssn
  FROM customer WHERE c_acctbal >= 0""",
    "dept": "SELECT n_nationkey AS dept_id, n_name AS dept_name, n_nationkey * 3 + 1 AS manager_id FROM nation",
    "att": _DAYS.format(where=""),
    "signup_days": _DAYS.format(where="WHERE event_type = 'signup'"),
    "rew": "SELECT emp_id, event_type AS type, CAST(request_ts AS DATE) AS date, cents FROM ev WHERE event_type = 'purchase'",
    "ded": "SELECT emp_id, event_type AS type, CAST(request_ts AS DATE) AS date, cents FROM ev WHERE event_type = 'error'",
    "weekdays": f"SELECT * FROM (VALUES {_WEEKDAY_ROWS}) AS w(n, day)",
    "weekly": """
  SELECT emp_id * 7 + n AS id, 200 + dept_id * 50 AS examination_price, day,
         CASE WHEN emp_id % 2 = 0 THEN 32400 ELSE 61200 END AS shift_start,
         CASE WHEN emp_id % 2 = 0 THEN 57600 ELSE 0 END AS shift_end, emp_id, dept_id
  FROM emp, weekdays WHERE lower(type) = 'doctor'""",
    "shift_list": f"SELECT * FROM (VALUES {_SHIFT_ROWS}) AS s(shift_id, shift_type, start_time, end_time)",
    "dated": """
  SELECT shift_id, shift_type, date, start_time, end_time
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), shift_list""",
    "order_shifts": """
  SELECT shift_id, shift_type, date, start_time, end_time
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), shift_list""",
    "emp_shift": "SELECT emp_id, emp_id % 3 + 1 AS shift_id FROM emp WHERE lower(type) IN ('nurse', 'receptionist')",
    "ord": """
  SELECT o_orderkey AS request_id, o_orderdate + to_seconds(o_orderkey * 61 % 86400) AS request_ts,
         o_custkey AS p_id, o_orderpriority AS payment_method, o_orderstatus AS order_status,
         CAST(o_orderdate AS DATE) AS order_date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders""",
    "inv": """
  SELECT o_orderkey AS invoice_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS payment_method,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey AS p_id, o_custkey AS emp_id
  FROM orders""",
    "det": """
  SELECT l_orderkey AS invoice_id, l_orderkey AS reservation_id,
         CASE l_returnflag WHEN 'A' THEN 'Clinic' WHEN 'N' THEN 'Pharmacy' ELSE 'lab' END AS reservation_type,
         l_suppkey AS process_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(l_quantity AS INTEGER) AS quantity
  FROM lineitem""",
    "resv": """
  SELECT o_orderkey AS reservation_id, o_orderdate AS date_time, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_custkey AS p_id, o_orderkey % 25 AS dept_id, o_custkey AS doctor_id
  FROM orders""",
    "drugs": """
  SELECT p_partkey AS drug_id, 'Drug ' || (p_partkey % 1500) AS drug_name, p_brand AS barcode, p_size AS quantity,
         CAST(round(p_retailprice * 100) AS BIGINT) AS cents
  FROM part""",
    "exams": """
  SELECT p_partkey AS item_id, 'Exam ' || p_partkey AS name, p_size AS delivery_duration,
         CAST(round(p_retailprice * 100) AS BIGINT) AS cents
  FROM part""",
    "exam_lines": """
  SELECT l_orderkey AS request_id,
         CASE WHEN l_linenumber = 7 AND l_tax >= 0.07 THEN 'no such exam' ELSE 'EXAM ' || (l_partkey % 150) END AS name
  FROM lineitem""",
    "room": """
  SELECT p_partkey AS room_id, p_type AS room_type, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part""",
    "room_status": """
  SELECT p_partkey AS room_id, CASE WHEN p_size <= 10 THEN 'Available' ELSE 'Reserved' END AS status FROM part""",
    "theatre": """
  SELECT n_nationkey AS room_id,
         CASE WHEN n_nationkey < 8 THEN 'surgery' WHEN n_nationkey < 13 THEN 'Recovery' ELSE 'normal' END AS room_type
  FROM nation""",
    "surgeries": """
  SELECT l_orderkey * 8 + l_linenumber AS reservation_id, CAST(min(l_shipdate) AS DATE) AS surgery_date,
         l_linenumber * 1800 + 25200 AS start_time,
         CAST(l_linenumber * 1800 + 25200 + min(l_quantity) * 300 AS INTEGER) AS end_time,
         CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS cents, l_orderkey AS p_id,
         min(l_suppkey) AS doctor_id, min(l_partkey) % 25 AS room_id, min(l_partkey) % 6 AS stuff_id
  FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "stays": """
  SELECT reservation_id, cents, surgery_date AS checkin,
         surgery_date + CAST(reservation_id % 3 AS INTEGER) AS checkout, p_id, room_id,
         CASE WHEN stuff_id < 2 THEN 'reserved_for_surgery' WHEN stuff_id < 4 THEN 'reserved_for_recovery'
              ELSE 'normal' END AS status
  FROM surgeries""",
}

# Which definitions a definition builds on.
_NEEDS = {
    "att": ["ev"],
    "signup_days": ["ev"],
    "rew": ["ev"],
    "ded": ["ev"],
    "weekly": ["emp", "weekdays"],
    "dated": ["shift_list"],
    "order_shifts": ["shift_list"],
    "emp_shift": ["emp"],
    "stays": ["surgeries"],
}


def with_roles(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` clause for the named definitions (and what they build on), then ``body``.

    ``body`` starts with further definitions or with SELECT.
    """
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    parts = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in ordered)
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{glue}{body}"


