"""Data-quality tests and snapshot maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, day
from wardflow.functions.clock import clock_text, day_first_text
from wardflow.functions.money import money
from wardflow.operators import layout, quality
from wardflow.operators.snapshots import append, replace_keys, update_from, upsert
from wardflow.session import scratch_path
from wardflow.sources import loaders
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


@registry.add(
    "dq_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_duplicate_keys(r: Roles) -> DataFrame:
    return quality.duplicate_keys(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@registry.add(
    "dq_orphans",
    with_roles("pat", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM pat WHERE p_id = o_custkey)"),
)
def dq_orphans(r: Roles) -> DataFrame:
    found = quality.orphans(r.table("orders"), r.patient, "o_custkey", "p_id")
    return found.select("o_orderkey", "o_custkey")


@registry.add(
    "dq_enum",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) NOT IN ('machinery', 'building', 'household')",
)
def dq_enum(r: Roles) -> DataFrame:
    found = quality.outside_list(r.table("customer"), "c_mktsegment", ["Machinery", "Building", "household"])
    return found.select("c_custkey", "c_mktsegment")


@registry.add(
    "dq_ranges",
    """SELECT * FROM (SELECT c_custkey, concat_ws(',', CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END, CASE WHEN NOT (c_nationkey > 0) THEN 'nation' END) AS broken
       FROM customer) WHERE broken <> ''""",
)
def dq_ranges(r: Roles) -> DataFrame:
    rules = {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") > 0}
    return quality.outside_range(r.table("customer"), rules).select("c_custkey", "broken")


@registry.add(
    "dq_ordered_pairs",
    with_roles("weekly", "SELECT id, shift_start, shift_end FROM weekly WHERE NOT (shift_end > shift_start)"),
)
def dq_ordered_pairs(r: Roles) -> DataFrame:
    return quality.unordered_pairs(r.weekly, "shift_start", "shift_end").select("id", "shift_start", "shift_end")


@registry.add(
    "dq_nulls",
    with_roles(
        "att",
        """SELECT 'emp_id' AS column_name, count(*) FILTER (WHERE emp_id IS NULL) AS n FROM att
        UNION ALL SELECT 'checkin', count(*) FILTER (WHERE checkin IS NULL) FROM att
        UNION ALL SELECT 'checkout', count(*) FILTER (WHERE checkout IS NULL) FROM att""",
    ),
)
def dq_nulls(r: Roles) -> DataFrame:
    return quality.missing_values(r.attendance, ["emp_id", "checkin", "checkout"])


@registry.add(
    "fill_defaults",
    with_roles(
        "att",
        "SELECT emp_id, strftime(attend_date, '%Y-%m-%d') AS attend_date, strftime(coalesce(checkout, checkin), '%Y-%m-%d %H:%M:%S') AS checkout FROM att",
    ),
)
def fill_defaults(r: Roles) -> DataFrame:
    return quality.fill_defaults(r.attendance, {"checkout": F.col("checkin")}).select("emp_id", "attend_date", "checkout")


@registry.add(
    "cascade_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def cascade_delete(r: Roles) -> DataFrame:
    deleted = r.table("orders").filter("o_orderstatus = 'P'")
    left = quality.cascade_delete(r.table("lineitem"), deleted, "l_orderkey", "o_orderkey")
    return left.select("l_orderkey", "l_linenumber", "l_partkey")


@registry.add(
    "set_null_on_delete",
    """SELECT c_custkey, coalesce(CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN NULL ELSE c_nationkey END, -1) AS c_nationkey FROM customer""",
)
def set_null_on_delete(r: Roles) -> DataFrame:
    gone = r.table("nation").filter("n_regionkey = 2")
    emptied = quality.set_null(r.table("customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey", "n_nationkey")
    return emptied.withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)))


@registry.add(
    "dq_invoice_balance",
    with_roles(
        "inv det",
        f"""s AS (SELECT invoice_id, sum(cents) AS cents FROM det GROUP BY 1)
        SELECT i.invoice_id, {amount('i.cents')} AS paid_money, {amount('coalesce(s.cents, 0)')} AS lines_total
        FROM inv i LEFT JOIN s ON s.invoice_id = i.invoice_id WHERE i.cents <> coalesce(s.cents, 0)""",
    ),
)
def dq_invoice_balance(r: Roles) -> DataFrame:
    return quality.invoice_balance(r.invoice, r.invoice_details)


# -------------------------------------------------------- snapshot maintenance


def prices(r: Roles) -> DataFrame:
    """Highest line price per part: the source of price updates."""
    lines = r.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    return lines.agg(F.max(money("l_extendedprice", 12)).alias("price"))


@registry.add(
    "snapshot_append",
    f"""SELECT user_id, event_type, {amount('CAST(round(value * 100) AS BIGINT)')} AS amount FROM events WHERE event_type = 'view'
        UNION ALL SELECT o_custkey, o_orderstatus, {amount('CAST(round(o_totalprice * 100) AS BIGINT)')} FROM orders""",
)
def snapshot_append(r: Roles) -> DataFrame:
    state = r.table("events").filter("event_type = 'view'").select("user_id", "event_type", money("value", 12).alias("amount"))
    rows = r.table("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("event_type"),
        money("o_totalprice", 12).alias("amount"),
    )
    return append(state, rows)


@registry.add(
    "snapshot_replace_keys",
    with_roles(
        "rew ded",
        f"""SELECT emp_id, {day('date')} AS date, {amount('cents')} AS amount FROM ded
            WHERE (emp_id, date) NOT IN (SELECT emp_id, date FROM rew)
        UNION ALL SELECT emp_id, {day('date')}, {amount('cents')} FROM rew""",
    ),
)
def snapshot_replace_keys(r: Roles) -> DataFrame:
    columns = ["emp_id", "date", "amount"]
    return replace_keys(r.deduction.select(*columns), r.reward.select(*columns), ["emp_id", "date"])


@registry.add(
    "snapshot_update_from",
    f"""WITH m AS (SELECT l_partkey, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)
    SELECT p_partkey, p_name, {amount('coalesce(m.cents, CAST(round(p_retailprice * 100) AS BIGINT))')} AS price
    FROM part LEFT JOIN m ON m.l_partkey = p_partkey""",
)
def snapshot_update_from(r: Roles) -> DataFrame:
    state = r.table("part").select("p_partkey", "p_name", money("p_retailprice", 12).alias("price"))
    return update_from(state, prices(r), ["p_partkey"], {"price": "price"})


@registry.add(
    "snapshot_upsert",
    f"""WITH a AS (SELECT c_custkey AS id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE c_acctbal >= 0),
    b AS (SELECT o_custkey + 700 AS id, max(o_orderpriority) AS name, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, {amount('coalesce(b.cents, a.cents)')} AS amount
    FROM a FULL JOIN b ON a.id = b.id""",
)
def snapshot_upsert(r: Roles) -> DataFrame:
    state, source = accounts(r)
    return upsert(state, source, ["id"], keep=["name"])


def accounts(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Accounts of customers, and the changes that their orders ask for."""
    state = r.table("customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), money("c_acctbal", 12).alias("amount")
    )
    source = r.table("orders").groupBy((F.col("o_custkey") + 700).alias("id")).agg(
        F.max("o_orderpriority").alias("name"), F.max(money("o_totalprice", 12)).alias("amount")
    )
    return state, source


# The same next states, for tables of which only the ranges of keys that a batch touches are written anew.
RANGES = 16


@registry.add("snapshot_replace_ranges", registry.sql["snapshot_replace_keys"])
def snapshot_replace_ranges(r: Roles) -> DataFrame:
    columns = ["emp_id", "date", "amount"]
    state, path = r.deduction.select(*columns), scratch_path(r.spark, "deduction")
    width = layout.width_for(state, "emp_id", RANGES)
    layout.create(state, path, "emp_id", width)
    layout.rewrite(
        path, state, r.reward.select(*columns), "emp_id", width, lambda old, new: replace_keys(old, new, ["emp_id", "date"])
    )
    return layout.read(state, path)


@registry.add("snapshot_update_ranges", registry.sql["snapshot_update_from"])
def snapshot_update_ranges(r: Roles) -> DataFrame:
    state = r.table("part").select("p_partkey", "p_name", money("p_retailprice", 12).alias("price"))
    path = scratch_path(r.spark, "part")
    width = layout.width_for(state, "p_partkey", RANGES)
    layout.create(state, path, "p_partkey", width)
    layout.rewrite(
        path, state, prices(r), "p_partkey", width, lambda old, new: update_from(old, new, ["p_partkey"], {"price": "price"})
    )
    return layout.read(state, path)


@registry.add("snapshot_upsert_ranges", registry.sql["snapshot_upsert"])
def snapshot_upsert_ranges(r: Roles) -> DataFrame:
    state, source = accounts(r)
    path = scratch_path(r.spark, "accounts")
    width = layout.width_for(state, "id", RANGES)
    layout.create(state, path, "id", width)
    layout.rewrite(path, state, source, "id", width, lambda old, new: upsert(old, new, ["id"], keep=["name"]))
    return layout.read(state, path)


# ---------------------------------------------------------------- seed files


def as_csv(r: Roles, df: DataFrame, name: str) -> str:
    """Write rows as the headerless CSV files the readers expect."""
    path = scratch_path(r.spark, name)
    df.write.option("header", False).csv(path)
    return path


@registry.add(
    "csv_patients",
    with_roles("pat", "SELECT p_id, fname, lname, email, '1980-01-01' AS birth_date, 'Female' AS gender, phone, ssn FROM pat"),
)
def csv_patients(r: Roles) -> DataFrame:
    columns = ["p_id", "fname", "lname", "email", "birth_date", "gender", "phone", "ssn"]
    return loaders.read_table(r.spark, as_csv(r, r.patient.select(*columns), "patients"), "patient")


@registry.add(
    "csv_employees",
    with_roles(
        "emp",
        f"""SELECT emp_id, fname, phone, ssn, {amount('cents')} AS salary, type, dept_id, '1980-01-01' AS birth_date, '2020-01-01' AS start_job, status FROM emp""",
    ),
)
def csv_employees(r: Roles) -> DataFrame:
    dates = {c: day_first_text(c) for c in ("birth_date", "start_job")}
    rows = r.employee.withColumns(dates).select(*loaders.EMPLOYEE_LAYOUTS["plain"])
    read = loaders.read_employees(r.spark, as_csv(r, rows, "employees"))
    return read.select("emp_id", "fname", "phone", "ssn", "salary", "type", "dept_id", "birth_date", "start_job", "status")


@registry.add(
    "csv_schedule",
    with_roles("weekly", "SELECT id, examination_price, day, shift_start, shift_end, emp_id, dept_id FROM weekly"),
)
def csv_schedule(r: Roles) -> DataFrame:
    times = {
        c: F.concat(F.floor(F.col(c) / 3600).cast("string"), F.lit(":00")) for c in ("shift_start", "shift_end")
    }
    columns = ["id", "examination_price", "day", "shift_start", "shift_end", "emp_id", "dept_id"]
    path = as_csv(r, r.weekly.withColumns(times).select(*columns), "schedule")
    return loaders.read_table(r.spark, path, "doctor_appointments")


@registry.add(
    "csv_dated_shifts",
    with_roles("order_shifts", f"SELECT shift_id, shift_type, {day('date')} AS date, start_time, end_time FROM order_shifts"),
)
def csv_dated_shifts(r: Roles) -> DataFrame:
    short = {
        "date": F.date_format("date", "yyyy-M-d"),
        "start_time": clock_text("start_time"),
        "end_time": clock_text("end_time"),
    }
    rows = r.order_shifts.withColumns(short).select("shift_id", "shift_type", "date", "start_time", "end_time")
    return loaders.read_table(r.spark, as_csv(r, rows, "shifts"), "shift_appointment")


@registry.add(
    "csv_rooms",
    with_roles("room", f"SELECT room_id, room_type, {amount('cents')} AS price_per_day FROM room"),
)
def csv_rooms(r: Roles) -> DataFrame:
    return loaders.read_codes(r.spark, as_csv(r, r.room, "rooms"), "room")
