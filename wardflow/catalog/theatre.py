"""Surgery reports, scheduling and cancellation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, day
from wardflow.operators.intervals import overlapping
from wardflow.plans import surgery
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

DATE = "1998-06-10"


def _clash(column: str) -> str:
    return f"""EXISTS (SELECT 1 FROM surgeries b WHERE b.surgery_date = a.surgery_date AND b.{column} = a.{column}
                 AND b.reservation_id <> a.reservation_id AND b.start_time <= a.end_time AND a.start_time <= b.end_time)"""


@registry.add(
    "surgery_conflicts",
    with_roles(
        "surgeries",
        f"""f AS (SELECT reservation_id, {_clash('doctor_id')} AS doctor_conflict, {_clash('p_id')} AS patient_conflict,
                 {_clash('room_id')} AS room_conflict, {_clash('stuff_id')} AS team_conflict FROM surgeries a)
        SELECT * FROM f WHERE doctor_conflict OR patient_conflict OR room_conflict OR team_conflict""",
    ),
)
def surgery_conflicts(r: Roles) -> DataFrame:
    return surgery.surgery_conflicts(r.surgeries)


@registry.add(
    "surgery_slot_check",
    with_roles(
        "surgeries",
        """SELECT o_orderkey AS request_id FROM orders o WHERE EXISTS (
             SELECT 1 FROM surgeries s WHERE s.surgery_date = CAST(o.o_orderdate AS DATE) AND s.room_id = o.o_custkey % 25
               AND s.start_time <= 36000 + o.o_custkey % 60 * 60 AND 32400 <= s.end_time)""",
    ),
)
def surgery_slot_check(r: Roles) -> DataFrame:
    """Requests from 9 to about 10 o'clock that meet a surgery in the room they ask for."""
    asked = r.table("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.to_date("o_orderdate").alias("surgery_date"),
        (F.col("o_custkey") % 25).alias("room_id"),
        F.lit(32400).alias("start_time"),
        (F.lit(36000) + F.col("o_custkey") % 60 * 60).cast("int").alias("end_time"),
    )
    return overlapping(asked, r.surgeries, ["surgery_date", "room_id"], "start_time", "end_time", "request_id")


@registry.add(
    "or_next_available",
    with_roles(
        "theatre surgeries",
        f"""SELECT t.room_id, coalesce((max(s.end_time) + 3600) % 86400, 25200) AS next_available FROM theatre t
        LEFT JOIN surgeries s ON s.room_id = t.room_id AND s.surgery_date = DATE '{DATE}' WHERE t.room_type = 'surgery' GROUP BY t.room_id""",
    ),
)
def or_next_available(r: Roles) -> DataFrame:
    return surgery.or_next_available(r.theatre, r.surgeries, F.lit(DATE).cast("date"))


@registry.add(
    "recovery_load",
    with_roles(
        "theatre stays",
        f"""SELECT t.room_id, count(s.room_id) AS reservations_count FROM theatre t LEFT JOIN stays s ON s.room_id = t.room_id
        AND s.checkin <= DATE '{DATE}' AND s.checkout >= DATE '{DATE}' WHERE lower(t.room_type) = 'recovery' GROUP BY t.room_id""",
    ),
)
def recovery_load(r: Roles) -> DataFrame:
    return surgery.recovery_load(r.theatre, r.stays, F.lit(DATE).cast("date"))


@registry.add(
    "recovery_load_by_date",
    with_roles(
        "theatre stays",
        f"""dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS surgery_date FROM orders),
        moves AS (SELECT room_id, checkin AS d, 1 AS k FROM stays UNION ALL SELECT room_id, checkout + 1, -1 FROM stays),
        per_day AS (SELECT room_id, d, sum(k) AS k FROM moves GROUP BY 1, 2)
        SELECT {day('q.surgery_date')} AS surgery_date, t.room_id, CAST(coalesce(sum(p.k), 0) AS BIGINT) AS load
        FROM dates q CROSS JOIN (SELECT room_id FROM theatre WHERE lower(room_type) = 'recovery') t
        LEFT JOIN per_day p ON p.room_id = t.room_id AND p.d <= q.surgery_date GROUP BY 1, 2""",
    ),
)
def recovery_load_by_date(r: Roles) -> DataFrame:
    dates = r.table("orders").select(F.to_date("o_orderdate").alias("surgery_date")).distinct()
    return surgery.recovery_loads_everywhere(dates, r.theatre, r.stays)


def surgery_requests(r: Roles, manual: bool = False) -> DataFrame:
    """Orders as surgery requests, five dates a month, asked for more than a year ahead.

    Urgent orders (manual: all) name a team; orders of status P come too late.
    """
    month = F.trunc(F.col("order_date"), "MM")
    wanted = F.date_add(month, (F.col("request_id") % 5 * 3).cast("int"))
    early = F.col("request_ts") - F.make_dt_interval(F.lit(400))
    late = F.col("request_ts") + F.make_dt_interval(F.lit(400))
    asked = r.orders.select(
        "request_id",
        F.when(F.col("order_status") == "P", late).otherwise(early).alias("request_ts"),
        "p_id",
        F.col("p_id").alias("doc_id"),
        F.concat(F.lit("nation_"), (F.col("request_id") % 26).cast("string")).alias("surgery_name"),
        wanted.alias("surgery_date"),
        "payment_method",
        F.when(F.lit(manual) | (F.col("payment_method") == "1-URGENT"), F.col("request_id") % 6 + 1).alias("stuff_id"),
    )
    if not manual:
        return asked
    start = F.when(F.col("payment_method") != "5-LOW", (F.col("request_id") % 12 * 3600 + 25200).cast("int"))
    return asked.withColumn("start_time", start)


def schedule(r: Roles, mode: str):
    teams = r.employee.select((F.col("emp_id") % 6 + 1).alias("stuff_id")).distinct()
    return surgery.schedule_surgery(
        surgery_requests(r, manual=mode == "manual"),
        r.employee,
        r.surgery,
        r.theatre,
        teams,
        r.surgeries,
        r.stays,
        r.emp_shift,
        r.order_shifts,
        r.invoice,
        mode=mode,
        room_status=r.theatre.select("room_id", F.lit("available").alias("status")),
    )


def schedule_sql(mode: str, select: str) -> str:
    """SQL that serves the n-th open request of every date in the n-th round.

    ``slots`` and ``loads`` carry what is taken on the date so far.
    """
    auto = mode == "auto"
    past = "CAST(surgery_date AS TIMESTAMP) < request_ts" if auto else "surgery_date < CAST(request_ts AS DATE)"
    friday = "WHEN dayname(surgery_date) = 'Friday' THEN '? Cannot schedule surgery on Friday. Staff is unavailable.'" if auto else ""
    team = "CASE WHEN o.payment_method = '1-URGENT' THEN o.request_id % 6 + 1 END" if auto else "o.request_id % 6 + 1"
    start = "CAST(NULL AS BIGINT)" if auto else "CASE WHEN o.payment_method <> '5-LOW' THEN o.request_id % 12 * 3600 + 25200 END"
    touching = "x.s <= e AND s <= x.e"
    if auto:
        team_test = ""
        team_pick = f"coalesce(team, list_min(list_filter([1, 2, 3, 4, 5, 6], lambda t: len(list_filter(slots, lambda x: x.team = t AND {touching})) = 0)))"
    else:
        team_test = f"WHEN len(list_filter(slots, lambda x: x.team = team AND {touching})) > 0 THEN '{surgery.TEAM_BUSY}'"
        team_pick = "team"
    return with_roles(
        "ord emp emp_shift order_shifts theatre surgeries stays",
        f"""desk AS (SELECT s.start_time AS b, s.end_time AS e, min(m.emp_id) AS clerk FROM order_shifts s JOIN emp_shift x ON x.shift_id = s.shift_id
                JOIN emp m ON m.emp_id = x.emp_id AND m.type = 'Receptionist' GROUP BY 1, 2),
        asked AS (SELECT o.payment_method, o.request_id, o.request_ts + CASE WHEN order_status = 'P' THEN INTERVAL 400 DAY ELSE INTERVAL (-400) DAY END AS request_ts,
                  o.p_id, CAST(date_trunc('month', order_date) AS DATE) + CAST(o.request_id % 5 * 3 AS INTEGER) AS surgery_date,
                  {team} AS team, {start} AS start, n.n_nationkey AS kind, n.n_nationkey * 10 + 30 AS minutes, d.emp_id IS NOT NULL AS consultant
                FROM ord o LEFT JOIN nation n ON n.n_nationkey = o.request_id % 26 LEFT JOIN emp d ON d.emp_id = o.p_id AND d.type = 'consultant_doctor'),
        tested AS (SELECT a.*, CASE WHEN NOT consultant THEN '? The selected doctor is either not found or not a consultant doctor.'
                  WHEN {past} THEN '? Cannot schedule surgery in the past.' {friday}
                  WHEN NOT EXISTS (SELECT 1 FROM desk WHERE hour(a.request_ts) * 3600 + minute(a.request_ts) * 60 + second(a.request_ts) BETWEEN b AND e)
                    THEN '? No receptionist available now.'
                  WHEN kind IS NULL THEN '? Surgery not found.' END AS guard FROM asked a),
        open AS (SELECT *, row_number() OVER (PARTITION BY surgery_date ORDER BY request_ts, request_id) AS n FROM tested WHERE guard IS NULL),
        days AS (SELECT DISTINCT surgery_date FROM open),
        loads AS (SELECT d.surgery_date, list({{'n': (SELECT count(*) FROM stays y WHERE y.room_id = t.room_id AND y.checkin <= d.surgery_date AND y.checkout >= d.surgery_date),
                          'room': CAST(t.room_id AS BIGINT)}}) AS loads FROM days d, theatre t WHERE lower(t.room_type) = 'recovery' GROUP BY 1),
        slots AS (SELECT d.surgery_date, list({{'room': CAST(s.room_id AS BIGINT), 'doc': CAST(s.doctor_id AS BIGINT), 'pat': CAST(s.p_id AS BIGINT), 'team': CAST(s.stuff_id AS BIGINT),
                          's': CAST(s.start_time AS BIGINT), 'e': CAST(s.end_time AS BIGINT)}}) FILTER (WHERE s.room_id IS NOT NULL) AS slots
                  FROM days d LEFT JOIN surgeries s ON s.surgery_date = d.surgery_date GROUP BY 1),
        served AS (
          SELECT surgery_date, CAST(0 AS BIGINT) AS n, coalesce(slots, []) AS slots, loads, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS refused,
                 CAST(NULL AS BIGINT) AS room, CAST(NULL AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS picked
          FROM slots JOIN loads USING (surgery_date)
          UNION ALL
          SELECT surgery_date, n, CASE WHEN refused IS NULL THEN list_append(slots, {{'room': room, 'doc': p_id, 'pat': p_id, 'team': picked, 's': s, 'e': e}}) ELSE slots END,
                 CASE WHEN refused IS NULL THEN list_transform(loads, lambda x: CASE WHEN x.room = rest THEN {{'n': x.n + 1, 'room': x.room}} ELSE x END) ELSE loads END,
                 request_id, refused, room, rest, s, e, picked
          FROM (
            SELECT *, CASE WHEN room IS NULL OR e > 86400 THEN '{surgery.NO_ROOM}'
                      WHEN len(list_filter(slots, lambda x: (x.doc = p_id OR x.pat = p_id) AND {touching})) > 0 THEN '{surgery.BUSY[mode]}'
                      {team_test} WHEN picked IS NULL THEN '{surgery.NO_TEAM}' END AS refused
            FROM (
              SELECT *, CAST({team_pick} AS BIGINT) AS picked, list_min(loads).room AS rest FROM (
                SELECT *, s + minutes * 60 AS e FROM (
                  SELECT v.surgery_date, o.n, v.slots, v.loads, o.request_id, o.p_id, o.team, o.minutes,
                         CASE WHEN o.start IS NULL THEN v.pick.t ELSE o.start END AS s,
                         CASE WHEN o.start IS NULL THEN v.pick.r ELSE list_min(list_filter(range(0, 8), lambda r: len(list_filter(v.slots, lambda x: x.room = r AND x.s <= o.start AND o.start <= x.e)) = 0)) END AS room
                  FROM (SELECT *, list_min(list_transform(range(0, 8), lambda r: {{'t': coalesce(list_max(list_transform(list_filter(slots, lambda x: x.room = r), lambda x: x.e)) + 3600, 25200), 'r': r}})) AS pick
                        FROM served) v
                  JOIN open o ON o.surgery_date = v.surgery_date AND o.n = v.n + 1))))),
        made AS (SELECT v.*, o.p_id, o.kind, o.minutes, o.payment_method, o.request_ts AS asked_at,
                   (SELECT min(clerk) FROM desk WHERE hour(o.request_ts) * 3600 + minute(o.request_ts) * 60 + second(o.request_ts) BETWEEN b AND e) AS clerk,
                   row_number() OVER (ORDER BY o.request_ts, o.request_id) AS place,
                   row_number() OVER (ORDER BY o.request_ts, o.request_id) + (SELECT max(reservation_id) FROM surgeries) AS reservation_id
                 FROM served v JOIN open o ON o.request_id = v.request_id WHERE v.refused IS NULL)
        {select}""",
        recursive=True,
    )


SCHEDULED = """SELECT t.request_id, m.reservation_id IS NOT NULL AS accepted, coalesce(m.reservation_id, -1) AS reservation_id,
               coalesce(t.guard, v.refused, '? Surgery scheduled: ' || strftime(t.surgery_date, '%Y-%m-%d') || ' from ' || lpad(CAST(m.s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m.s // 60 % 60 AS VARCHAR), 2, '0')
                 || ' to ' || lpad(CAST(m.e // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m.e // 60 % 60 AS VARCHAR), 2, '0') || '. OR Room: ' || m.room || ', Recovery Room: ' || m.rest
                 || '. Reservation ID: ' || m.reservation_id) AS message
        FROM tested t LEFT JOIN served v ON v.request_id = t.request_id LEFT JOIN made m ON m.request_id = t.request_id"""


@registry.add("surgery_schedule_auto", schedule_sql("auto", SCHEDULED))
def surgery_schedule_auto(r: Roles) -> DataFrame:
    """Served one after the other per date; the tests compare it with a plain loop as well."""
    out = schedule(r, "auto").outcomes
    return out.withColumn("reservation_id", F.coalesce("reservation_id", F.lit(-1)))


def at_minutes(minutes: str) -> str:
    return f"strftime(CAST(surgery_date AS TIMESTAMP) + to_minutes(CAST({minutes} AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


@registry.add(
    "surgery_reservations",
    schedule_sql(
        "auto",
        f"""SELECT reservation_id, {day('surgery_date')} AS surgery_date, s AS start_time, e AS end_time, {amount('kind * 100000 + 100000')} AS paid_money,
          p_id, p_id AS doctor_id, clerk AS receptionist_id, CAST(kind AS BIGINT) AS surgery_id, room AS room_id, picked AS stuff_id, 'scheduled' AS status FROM made""",
    ),
)
def surgery_reservations(r: Roles) -> DataFrame:
    return schedule(r, "auto").tables["surgery_reservation"]


@registry.add(
    "surgery_stays",
    schedule_sql(
        "auto",
        f"""SELECT {amount('room * 10000 + 50000')} AS paid_money, {at_minutes('0')} AS checkin, {at_minutes('minutes + 60')} AS checkout,
            room AS room_id, p_id, clerk AS emp_id, 'reserved_for_surgery' AS status FROM made
          UNION ALL SELECT {amount('rest * 10000 + 50000')}, {at_minutes('minutes + 60')}, {at_minutes('minutes + 120')},
            rest, p_id, clerk, 'reserved_for_recovery' FROM made""",
    ),
)
def surgery_stays(r: Roles) -> DataFrame:
    return schedule(r, "auto").tables["room_reservation"]


@registry.add(
    "surgery_invoices",
    schedule_sql(
        "auto",
        f"""SELECT place + (SELECT max(o_orderkey) FROM orders) AS invoice_id, {day('asked_at')} AS date, payment_method,
            {amount('kind * 100000 + 100000 + (room + rest) * 10000 + 100000')} AS paid_money, p_id, clerk AS emp_id FROM made""",
    ),
)
def surgery_invoices(r: Roles) -> DataFrame:
    return schedule(r, "auto").tables["invoice"]


@registry.add(
    "surgery_invoice_lines",
    schedule_sql(
        "auto",
        f"""SELECT place + (SELECT max(o_orderkey) FROM orders) AS invoice_id, reservation_id, l.name AS reservation_type, l.process AS process_id,
            {amount('l.cents')} AS unit_price, CAST(1 AS BIGINT) AS quantity, {amount('l.cents')} AS total, CAST(l.dept AS BIGINT) AS dept_id
          FROM (SELECT *, unnest([
              {{'name': 'Surgery', 'process': CAST(kind AS BIGINT), 'cents': CAST(kind * 100000 + 100000 AS BIGINT), 'dept': 11}},
              {{'name': 'Operating Room', 'process': room, 'cents': room * 10000 + 50000, 'dept': 17}},
              {{'name': 'Recovery Room', 'process': rest, 'cents': rest * 10000 + 50000, 'dept': 17}}]) AS l FROM made)""",
    ),
)
def surgery_invoice_lines(r: Roles) -> DataFrame:
    return schedule(r, "auto").tables["invoice_details"]


@registry.add(
    "surgery_room_status",
    schedule_sql(
        "auto",
        """SELECT CAST(room_id AS BIGINT) AS room_id,
            CASE WHEN room_id IN (SELECT room FROM made UNION ALL SELECT rest FROM made) THEN 'reserved' ELSE 'available' END AS status FROM theatre""",
    ),
)
def surgery_room_status(r: Roles) -> DataFrame:
    return schedule(r, "auto").tables["room_status"]


@registry.add("surgery_schedule_manual", schedule_sql("manual", SCHEDULED))
def surgery_schedule_manual(r: Roles) -> DataFrame:
    """Served one after the other per date; the tests compare it with a plain loop as well."""
    out = schedule(r, "manual").outcomes
    return out.withColumn("reservation_id", F.coalesce("reservation_id", F.lit(-1)))


def cancel(r: Roles):
    """Orders of status F cancel the first surgery of the order; most orders have none."""
    asked = r.orders.filter("order_status = 'F'").select(
        "request_id", "request_ts", (F.col("request_id") * 8 + 1).alias("reservation_id")
    )
    status = r.theatre.select("room_id", F.lit("reserved").alias("status"))
    details = r.invoice_details.withColumn("reservation_id", F.col("invoice_id") * 8 + F.col("quantity") % 7)
    return surgery.cancel_surgery(asked, r.surgeries, r.stays, status, r.invoice, details)


CANCEL = with_roles(
    "ord surgeries stays inv det theatre",
    """asked AS (SELECT request_id, request_ts, request_id * 8 + 1 AS reservation_id FROM ord WHERE order_status = 'F'),
    found AS (SELECT a.*, s.surgery_date, s.p_id, s.surgery_date > CAST(a.request_ts AS DATE) OR (s.surgery_date = CAST(a.request_ts AS DATE)
                 AND s.start_time > hour(a.request_ts) * 3600 + minute(a.request_ts) * 60 + second(a.request_ts)) AS ahead
              FROM asked a JOIN surgeries s ON s.reservation_id = a.reservation_id),
    off AS (SELECT t.reservation_id FROM stays t WHERE t.status IN ('reserved_for_surgery', 'reserved_for_recovery')
              AND EXISTS (SELECT 1 FROM found f WHERE f.p_id = t.p_id AND t.checkin >= f.surgery_date)),
    lines AS (SELECT invoice_id, invoice_id * 8 + quantity % 7 AS reservation_id FROM det),
    kept AS (SELECT * FROM lines WHERE reservation_id NOT IN (SELECT reservation_id FROM found))""",
)


@registry.add(
    "cancel_surgery",
    CANCEL
    + """
    SELECT a.request_id, f.reservation_id IS NOT NULL AS accepted,
           CASE WHEN f.reservation_id IS NULL THEN '❌ Reservation not found.'
                ELSE '✅ Surgery reservation canceled successfully. Related rooms freed, invoice details deleted, and paid money set to 0.' END AS message
    FROM asked a LEFT JOIN found f ON f.request_id = a.request_id""",
)
def cancel_surgery(r: Roles) -> DataFrame:
    return cancel(r).outcomes


@registry.add(
    "cancel_surgery_table",
    CANCEL
    + f"""
    SELECT s.reservation_id, CASE WHEN f.reservation_id IS NULL THEN 'scheduled' ELSE 'canceled' END AS status,
           {amount('CASE WHEN f.reservation_id IS NULL THEN s.cents ELSE 0 END')} AS paid_money
    FROM surgeries s LEFT JOIN (SELECT DISTINCT reservation_id FROM found) f ON f.reservation_id = s.reservation_id""",
)
def cancel_surgery_table(r: Roles) -> DataFrame:
    return cancel(r).tables["surgery_reservation"].select("reservation_id", "status", "paid_money")


@registry.add(
    "cancel_surgery_stays",
    CANCEL
    + f"""
    SELECT t.reservation_id, CASE WHEN o.reservation_id IS NULL THEN t.status ELSE 'canceled' END AS status,
           {amount('CASE WHEN o.reservation_id IS NULL THEN t.cents ELSE 0 END')} AS paid_money
    FROM stays t LEFT JOIN off o ON o.reservation_id = t.reservation_id""",
)
def cancel_surgery_stays(r: Roles) -> DataFrame:
    return cancel(r).tables["room_reservation"].select("reservation_id", "status", "paid_money")


@registry.add(
    "cancel_surgery_rooms",
    CANCEL
    + """
    SELECT h.room_id, CASE WHEN EXISTS (SELECT 1 FROM stays t JOIN off o ON o.reservation_id = t.reservation_id
             JOIN found f ON f.p_id = t.p_id AND f.ahead AND t.checkin >= f.surgery_date WHERE t.room_id = h.room_id)
           THEN 'available' ELSE 'reserved' END AS status FROM theatre h""",
)
def cancel_surgery_rooms(r: Roles) -> DataFrame:
    return cancel(r).tables["room_status"]


@registry.add(
    "cancel_surgery_invoices",
    CANCEL
    + f"""
    SELECT invoice_id, {amount('cents')} AS paid_money FROM inv WHERE invoice_id IN (SELECT invoice_id FROM kept)""",
)
def cancel_surgery_invoices(r: Roles) -> DataFrame:
    return cancel(r).tables["invoice"].select("invoice_id", "paid_money")


@registry.add(
    "orphan_invoices",
    with_roles("inv det", "SELECT invoice_id, p_id FROM inv WHERE invoice_id NOT IN (SELECT invoice_id FROM det WHERE reservation_type = 'Clinic')"),
)
def orphan_invoices(r: Roles) -> DataFrame:
    clinic = r.invoice_details.filter("reservation_type = 'Clinic'")
    return surgery.orphan_invoices(r.invoice, clinic).select("invoice_id", "p_id")
