"""Streaming jobs, run over the test tables as file streams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, clock, day
from wardflow.functions.clock import moment
from wardflow.functions.money import money
from wardflow.plans import pharmacy
from wardflow.session import scratch_path
from wardflow.sources.roles import Roles, with_roles
from wardflow.streaming import attendance, operations
from wardflow.streaming.state import AppendedTable, VersionedTable, to_folder

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


def stream(r: Roles, table: str) -> DataFrame:
    """One test table as a file stream."""
    schema = r.table(table).schema
    return r.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(r.folder)


def event_stream(r: Roles, *kinds: str) -> DataFrame:
    rows = stream(r, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") * 12).alias("emp_id"),
        "event_type",
    )
    return rows.filter(F.col("event_type").isin(*kinds)) if kinds else rows


@registry.add(
    "stream_first_checkin",
    with_roles("ev", f"SELECT DISTINCT emp_id, {day('request_ts')} AS attend_date FROM ev"),
)
def stream_first_checkin(r: Roles) -> DataFrame:
    out = scratch_path(r.spark, "checkins")
    found = attendance.first_check_ins(event_stream(r)).select("emp_id", "attend_date")
    to_folder(found, f"{out}/rows", f"{out}/state")
    return r.spark.read.schema(found.schema).parquet(f"{out}/rows")


PARTS = 3
# Days that a check-in may be behind the newest one.
BEHIND = 7


def in_parts(r: Roles, *jobs) -> list[DataFrame]:
    """Run streaming jobs over the events in several deliveries, each a micro-batch; gives the tables written.

    Event n comes with delivery n % 3. A run takes all new files as one batch and goes on from its checkpoint.
    """
    base = scratch_path(r.spark, "deliveries")
    columns = [F.col("request_id"), F.col("request_ts").cast("timestamp").alias("ts"), F.col("emp_id")]
    rows = r.events.select(*columns)
    found = []
    for part in range(PARTS):
        rows.where(F.col("request_id") % PARTS == part).write.parquet(f"{base}/in/part={part}")
        events = r.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        found = [job(events) for job in jobs]
        for number, out in enumerate(found):
            to_folder(out, f"{base}/out{number}", f"{base}/state{number}")
    return [r.spark.read.schema(out.schema).parquet(f"{base}/out{number}") for number, out in enumerate(found)]


def late(events: DataFrame) -> DataFrame:
    return attendance.late_rows(events, f"{BEHIND} days")


def in_time(events: DataFrame) -> DataFrame:
    return attendance.first_check_ins(events, f"{BEHIND} days").select("emp_id", "attend_date", "ts")


@registry.add(
    "stream_late_rows",
    with_roles(
        "ev",
        f"""newest AS (SELECT request_id % {PARTS} AS part, max(request_ts) AS ts FROM ev GROUP BY 1),
        marks AS (SELECT p.part, max(n.ts) - INTERVAL {BEHIND} DAY AS mark FROM newest p JOIN newest n ON n.part < p.part GROUP BY 1)
        SELECT request_id, emp_id, {clock('request_ts')} AS ts FROM ev JOIN marks ON marks.part = request_id % {PARTS} WHERE request_ts <= mark""",
    ),
)
def stream_late_rows(r: Roles) -> DataFrame:
    """Events of later deliveries that are more than a week behind the newest one before."""
    return in_parts(r, late)[0].select("request_id", "emp_id", "ts")


@registry.add(
    "stream_checkins_with_late",
    with_roles("ev", f"SELECT DISTINCT emp_id, {day('request_ts')} AS attend_date FROM ev"),
)
def stream_checkins_with_late(r: Roles) -> DataFrame:
    """The stream over several deliveries and its late rows together miss no day."""
    behind, found = in_parts(r, late, in_time)
    return attendance.with_late_check_ins(found, behind).select("emp_id", "attend_date")


# A check-in is given out as unmatched two days after it; with the delay of an hour, days
# three days before the watermark have all their rows.
SETTLED_AFTER = 3


@registry.add(
    "stream_missing_checkout",
    with_roles(
        "ev weekly emp_shift dated",
        f"""shifts AS (
          SELECT w.emp_id, d.date AS attend_date, w.shift_start AS s, w.shift_end AS t FROM weekly w JOIN (SELECT DISTINCT date FROM dated) d ON dayname(d.date) = w.day
          UNION ALL SELECT x.emp_id, d.date, d.start_time, d.end_time FROM emp_shift x JOIN dated d ON d.shift_id = x.shift_id),
        ends AS (SELECT emp_id, attend_date, min(CAST(attend_date AS TIMESTAMP) + CASE WHEN t = 0 THEN to_seconds(86340) WHEN t < s THEN to_seconds(86400 + t)
                   ELSE to_seconds(t) END) AS shift_end FROM shifts GROUP BY 1, 2),
        ins AS (SELECT v.emp_id, CAST(v.request_ts AS DATE) AS attend_date, v.request_ts AS checkin, e.shift_end FROM ev v
                JOIN ends e ON e.emp_id = v.emp_id AND e.attend_date = CAST(v.request_ts AS DATE) WHERE v.event_type IN ('signup', 'view')),
        pairs AS (SELECT i.*, o.request_ts AS checkout FROM ins i LEFT JOIN ev o ON o.event_type IN ('click', 'error') AND o.emp_id = i.emp_id
                  AND CAST(o.request_ts AS DATE) = i.attend_date AND o.request_ts >= i.checkin AND o.request_ts <= i.shift_end + INTERVAL 30 MINUTE)
        SELECT emp_id, {day('attend_date')} AS attend_date, min(checkout) IS NULL AS missing FROM pairs
        WHERE attend_date < CAST((SELECT least(max(request_ts) FILTER (WHERE event_type IN ('signup', 'view')),
            max(request_ts) FILTER (WHERE event_type IN ('click', 'error'))) FROM ev) - INTERVAL 1 HOUR AS DATE) - {SETTLED_AFTER} GROUP BY emp_id, attend_date""",
    ),
)
def stream_missing_checkout(r: Roles) -> DataFrame:
    """Signups and views are arrivals, clicks and errors departures; days the watermark has left behind are settled."""
    out = scratch_path(r.spark, "pairs")
    pairs = attendance.pair_check_outs(
        event_stream(r, "signup", "view"), event_stream(r, "click", "error"), r.employee, r.weekly, r.dated, r.emp_shift
    )
    to_folder(pairs, f"{out}/rows", f"{out}/state")
    settled = attendance.settled_days(r.spark.read.schema(pairs.schema).parquet(f"{out}/rows"))
    newest = [F.max(F.when(F.col("event_type").isin(*kinds), F.col("request_ts"))) for kinds in (("signup", "view"), ("click", "error"))]
    watermark = r.events.agg(F.least(*newest) - F.expr("INTERVAL 1 HOUR")).scalar()
    known = F.col("attend_date") < F.date_sub(watermark.cast("date"), SETTLED_AFTER)
    return settled.filter(known).select("emp_id", "attend_date", "missing")


NOW = "2001-09-01 12:00:00"


STOCK = with_roles(
    "drugs",
    """lines AS (SELECT l_orderkey AS p, l_partkey % 1500 AS drug_id, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
    line AS (SELECT drug_id, p, sum(q) AS q FROM lines GROUP BY ALL),
    filled AS (SELECT line.*, d.cents, d.quantity * 10 AS stock, sum(q) OVER (PARTITION BY line.drug_id ORDER BY p) AS r
               FROM line JOIN drugs d ON d.drug_id = line.drug_id),
    sale AS (SELECT p, drug_id, cents, CAST(least(stock, r) - least(stock, r - q) AS BIGINT) AS n FROM filled)""",
)


class StockStream(NamedTuple):
    last: int
    stock: VersionedTable
    invoice_details: AppendedTable
    outcomes: AppendedTable


def sold_lines(r: Roles) -> StockStream:
    """Order lines sold from stock as they arrive."""
    out = scratch_path(r.spark, "stock")
    lines = stream(r, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        # One moment per request: its lines are served together, and requests in the order of their ids.
        F.lit(NOW).cast("timestamp_ntz").alias("request_ts"),
        F.col("l_orderkey").alias("prescription_id"),
        F.concat(F.lit("drug "), (F.col("l_partkey") % 1500).cast("string")).alias("drug_name"),
        F.col("l_quantity").cast("int").alias("req_qty"),
    )
    drugs = r.drugs.withColumn("quantity", F.col("quantity") * 10)
    none = r.table("orders").filter(F.lit(False))
    nothing_sold = none.select(
        F.col("o_orderkey").alias("prescription_id"),
        F.col("o_custkey").alias("drug_id"),
        F.lit(0).cast("long").alias("quantity"),
        money("o_totalprice").alias("total_price"),
    )
    no_details = none.select(
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_orderkey").alias("reservation_id"),
        F.lit("").alias("reservation_type"),
        F.col("o_custkey").alias("process_id"),
        money("o_totalprice").alias("unit_price"),
        F.lit(0).cast("long").alias("quantity"),
        money("o_totalprice", 12).alias("total"),
        F.lit(0).alias("dept_id"),
    )
    no_outcomes = none.select(
        F.col("o_orderkey").alias("request_id"),
        F.lit(True).alias("accepted"),
        F.lit("").alias("message"),
        money("o_totalprice", 19).alias("total"),
    )
    no_lines = r.table("lineitem").filter(F.lit(False)).select(
        F.col("l_orderkey").alias("request_id"),
        F.lit(NOW).cast("timestamp_ntz").alias("request_ts"),
        F.col("l_orderkey").alias("prescription_id"),
        F.lit("").alias("drug_name"),
        F.lit(0).alias("req_qty"),
    )
    stock = VersionedTable(drugs, f"{out}/stock")
    details = AppendedTable(no_details, f"{out}/details")
    outcomes = AppendedTable(no_outcomes, f"{out}/outcomes")
    last = operations.sell_from_stream(
        lines,
        r.table("orders").select(F.col("o_orderkey").alias("prescription_id"), F.col("o_custkey").alias("p_id")),
        stock,
        AppendedTable(nothing_sold, f"{out}/sold"),
        VersionedTable(pharmacy.low_stock(drugs.filter(F.lit(False)), moment(NOW)), f"{out}/alerts"),
        VersionedTable(no_lines, f"{out}/waiting"),
        AppendedTable(r.invoice, f"{out}/invoices"),
        details,
        outcomes,
        moment(NOW),
        f"{out}/state",
    )
    return StockStream(last, stock, details, outcomes)


@registry.add(
    "stream_stock",
    STOCK
    + """
    SELECT d.drug_id, CAST(d.quantity * 10 - coalesce(s.n, 0) AS BIGINT) AS quantity
    FROM drugs d LEFT JOIN (SELECT drug_id, sum(n) AS n FROM sale GROUP BY 1) s ON s.drug_id = d.drug_id""",
)
def stream_stock(r: Roles) -> DataFrame:
    """What is left of each drug."""
    sales = sold_lines(r)
    return sales.stock.after(r.spark, sales.last).select("drug_id", "quantity")


@registry.add(
    "stream_sale_outcomes",
    STOCK
    + f"""
    SELECT p AS request_id, true AS accepted, {amount('CAST(coalesce(sum(cents * n) FILTER (WHERE n > 0), 0) AS BIGINT)')} AS total FROM sale GROUP BY p""",
)
def stream_sale_outcomes(r: Roles) -> DataFrame:
    """The answer to every request."""
    sales = sold_lines(r)
    return sales.outcomes.after(r.spark, sales.last).select("request_id", "accepted", F.col("total"))


@registry.add(
    "stream_sale_invoices",
    STOCK
    + f"""
    SELECT p AS reservation_id, drug_id AS process_id, n AS quantity, {amount('cents * n')} AS total FROM sale WHERE n > 0""",
)
def stream_sale_invoices(r: Roles) -> DataFrame:
    """The invoice lines of all sales."""
    sales = sold_lines(r)
    return sales.invoice_details.after(r.spark, sales.last).select("reservation_id", "process_id", "quantity", "total")


PLACES = f"""line AS (SELECT request_id, emp_id // 12 % 10 AS doctor_id, CAST(request_ts AS DATE) AS d,
                 row_number() OVER (PARTITION BY emp_id // 12 % 10, CAST(request_ts AS DATE) ORDER BY request_ts, request_id) AS place FROM ev)"""


def booking_outcomes(r: Roles) -> DataFrame:
    """Events as bookings with ten doctors, at most 20 a day each."""
    out = scratch_path(r.spark, "bookings")
    requests = event_stream(r).select(
        "request_id",
        F.col("ts").cast("timestamp_ntz").alias("request_ts"),
        (F.col("emp_id") / 12 % 10).cast("long").alias("doctor_id"),
    )
    none = requests_like(r)
    operations.book_from_stream(requests, VersionedTable(none, f"{out}/counts"), f"{out}/outcomes", f"{out}/state")
    return r.spark.read.parquet(f"{out}/outcomes")


@registry.add(
    "stream_booking_cap",
    with_roles("ev", f"{PLACES}\n        SELECT request_id, doctor_id, {day('d')} AS day FROM line WHERE place <= 20"),
)
def stream_booking_cap(r: Roles) -> DataFrame:
    return booking_outcomes(r).filter("accepted").select("request_id", "doctor_id", "day")


@registry.add(
    "stream_booking_outcomes",
    with_roles(
        "ev",
        f"""{PLACES}
        SELECT request_id, place <= 20 AS accepted, CASE WHEN place <= 20 THEN '' ELSE '{operations.FULL}' END AS message, false AS late FROM line""",
    ),
)
def stream_booking_outcomes(r: Roles) -> DataFrame:
    """Every request has an answer; in one batch none is late."""
    answered = booking_outcomes(r)
    return answered.select("request_id", "accepted", F.coalesce("message", F.lit("")).alias("message"), "late")


def requests_like(r: Roles) -> DataFrame:
    """An empty table of bookings per doctor and day."""
    return r.events.filter(F.lit(False)).select(
        F.col("request_id").alias("doctor_id"), F.to_date("request_ts").alias("day"), F.col("request_id").alias("booked")
    )


@registry.add(
    "stream_revenue",
    with_roles(
        "inv emp dept",
        f"""SELECT d.dept_name, {amount('sum(i.cents)')} AS total_revenue
        FROM inv i JOIN emp e ON i.emp_id = e.emp_id JOIN dept d ON e.dept_id = d.dept_id GROUP BY d.dept_name""",
    ),
)
def stream_revenue(r: Roles) -> DataFrame:
    out = scratch_path(r.spark, "revenue")
    invoices = stream(r, "orders").select(
        F.col("o_custkey").alias("emp_id"), money("o_totalprice", 12).alias("paid_money")
    )
    empty = r.department.filter(F.lit(False)).select("dept_name", F.lit(0).cast("decimal(28,2)").alias("total_revenue"))
    totals = VersionedTable(empty, f"{out}/totals")
    last = operations.refresh_revenue(invoices, r.employee, r.department, totals, f"{out}/state")
    return totals.after(r.spark, last)


@registry.add(
    "stream_patient_months",
    with_roles("resv", "SELECT strftime(date_time, '%Y-%m') AS month, count(DISTINCT p_id) AS new_patients FROM resv GROUP BY 1"),
)
def stream_patient_months(r: Roles) -> DataFrame:
    out = scratch_path(r.spark, "months")
    reservations = stream(r, "orders").select(F.col("o_custkey").alias("p_id"), F.col("o_orderdate").alias("date_time"))
    empty = r.reservation.filter(F.lit(False)).select(
        F.date_format("date_time", "yyyy-MM").alias("month"), "p_id", F.col("date_time").alias("first_seen")
    )
    pairs = AppendedTable(empty, f"{out}/pairs")
    last = operations.refresh_patient_months(reservations, pairs, f"{out}/state")
    return pairs.after(r.spark, last).groupBy("month").agg(F.count("*").alias("new_patients"))
