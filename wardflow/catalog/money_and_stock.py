"""Pharmacy and rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.catalog.common import Registry, amount, amount_text, day, or_minus_one
from wardflow.functions.clock import moment
from wardflow.functions.money import money, room_payment
from wardflow.plans import pharmacy, rooms
from wardflow.sources.roles import Roles, with_roles

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

NOW = "2001-09-01 12:00:00"

# ------------------------------------------------------------------ pharmacy


def sale_lines(r: Roles) -> DataFrame:
    """Order lines as prescription lines: other case, blanks around, some names unknown."""
    unknown = (F.col("l_linenumber") == 7) & (F.col("l_tax") >= 0.07)
    number = (F.col("l_partkey") % 1500).cast("string")
    return r.table("lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.when(unknown, "unknown").otherwise(F.concat(F.lit("  DRUG "), number, F.lit(" "))).alias("drug_name"),
        F.col("l_quantity").cast("int").alias("req_qty"),
    )


def first_alerts(r: Roles) -> DataFrame:
    return pharmacy.low_stock(r.drugs, moment("2001-01-01 00:00:00"), threshold=5)


def sale(r: Roles):
    """Orders as sales: every fifth one repeats the prescription of the order before it."""
    orders = r.table("orders")
    repeat = F.when(F.col("request_id") % 5 == 4, 1).otherwise(0)
    requests = r.orders.select(
        "request_id",
        "request_ts",
        (F.col("request_id") - repeat).alias("prescription_id"),
        "payment_method",
        F.lit(7).alias("emp_id"),
    )
    prescriptions = orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("prescription_id"), F.col("o_custkey").alias("p_id")
    )
    sold = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("prescription_id"))
    stock = r.drugs.withColumn("quantity", F.col("quantity") * 10)
    return pharmacy.prescription_sale(
        requests, sale_lines(r), prescriptions, sold, stock, first_alerts(r), r.invoice, moment(NOW)
    )


SALE = with_roles(
    "ord drugs",
    f"""lookup AS (SELECT lower(trim(drug_name)) AS name, min(drug_id) AS drug_id FROM drugs GROUP BY 1),
    lines AS (SELECT l_orderkey AS request_id, CASE WHEN l_linenumber = 7 AND l_tax >= 0.07 THEN 'unknown' ELSE '  DRUG ' || (l_partkey % 1500) || ' ' END AS drug_name,
                     CAST(l_quantity AS INTEGER) AS req_qty FROM lineitem),
    named AS (SELECT l.*, k.drug_id FROM lines l LEFT JOIN lookup k ON k.name = lower(trim(l.drug_name))),
    bad AS (SELECT DISTINCT request_id FROM named WHERE drug_id IS NULL),
    asked AS (SELECT request_id, request_ts, request_id - CASE WHEN request_id % 5 = 4 THEN 1 ELSE 0 END AS prescription_id, payment_method FROM ord),
    t AS (SELECT a.*, CASE WHEN p.o_orderkey IS NULL THEN 'Prescription not found.' WHEN p.o_orderstatus = 'P' THEN 'This prescription has already been processed.'
               WHEN b.request_id IS NOT NULL THEN 'One or more drugs not found in inventory.' END AS refused
          FROM asked a LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') p ON p.o_orderkey = a.prescription_id
          LEFT JOIN bad b ON b.request_id = a.request_id),
    -- a prescription on file as sold counts whether or not it is known
    first AS (SELECT prescription_id, min((request_ts, request_id)) AS k FROM t WHERE refused IS NULL GROUP BY 1),
    serving AS (SELECT prescription_id, k[1] AS request_ts, k[2] AS request_id FROM first),
    wanted AS (SELECT s.request_id, s.request_ts, s.prescription_id, n.drug_id, min(n.drug_name) AS drug_name, sum(n.req_qty) AS req
               FROM serving s JOIN named n ON n.request_id = s.request_id GROUP BY 1, 2, 3, 4),
    line AS (SELECT w.*, d.cents, d.quantity * 10 AS stock, sum(req) OVER (PARTITION BY w.drug_id ORDER BY request_ts, request_id) AS r
             FROM wanted w JOIN drugs d ON d.drug_id = w.drug_id),
    served AS (SELECT *, CAST(least(stock, r) - least(stock, r - req) AS BIGINT) AS sold, CAST(stock - least(stock, r) AS BIGINT) AS left_over FROM line),
    per_request AS (SELECT request_id, CAST(sum(cents * sold) FILTER (WHERE sold > 0) AS BIGINT) AS total,
                           string_agg('• ' || drug_name || ': ' || left_over || chr(13), '' ORDER BY drug_name, drug_id) AS stock_text FROM served GROUP BY 1)""",
)


@registry.add(
    "prescription_sale",
    SALE
    + f"""
    SELECT t.request_id, coalesce(s.request_id = t.request_id, false) AS accepted,
           CASE WHEN s.request_id = t.request_id THEN 'Sale completed successfully.' || chr(13) || 'Total Invoice Amount: ' || {amount_text('coalesce(f.total, 0)')}
                     || chr(13) || 'Remaining Stock:' || chr(13) || coalesce(f.stock_text, '')
                WHEN t.refused IS NOT NULL THEN t.refused WHEN f.total > 0 THEN 'This prescription has already been processed.'
                ELSE 'Deferred to the next batch.' END AS message,
           {amount('CASE WHEN s.request_id = t.request_id THEN coalesce(f.total, 0) ELSE 0 END')} AS total
    FROM t LEFT JOIN serving s ON s.prescription_id = t.prescription_id LEFT JOIN per_request f ON f.request_id = s.request_id""",
)
def prescription_sale(r: Roles) -> DataFrame:
    return sale(r).outcomes.withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(19,2)")))


@registry.add(
    "prescription_sale_lines",
    SALE
    + f"""
    SELECT prescription_id, drug_id, sold AS quantity, {amount('cents * sold')} AS total_price FROM served WHERE sold > 0""",
)
def prescription_sale_lines(r: Roles) -> DataFrame:
    return sale(r).tables["prescription_drugs"]


@registry.add(
    "prescription_sale_stock",
    SALE
    + """
    SELECT d.drug_id, CAST(d.quantity * 10 - coalesce(sum(s.sold), 0) AS BIGINT) AS quantity
    FROM drugs d LEFT JOIN served s ON s.drug_id = d.drug_id GROUP BY d.drug_id, d.quantity""",
)
def prescription_sale_stock(r: Roles) -> DataFrame:
    return sale(r).tables["pharmacy_drugs"].select("drug_id", "quantity")


@registry.add(
    "prescription_sale_invoices",
    SALE
    + f"""
    SELECT row_number() OVER (ORDER BY t.request_ts, t.request_id) + (SELECT max(o_orderkey) FROM orders) AS invoice_id, '2001-09-01' AS date,
           t.payment_method, {amount('f.total')} AS paid_money, o.o_custkey AS p_id, 7 AS emp_id
    FROM serving s JOIN t ON t.request_id = s.request_id JOIN per_request f ON f.request_id = s.request_id
    JOIN orders o ON o.o_orderkey = t.prescription_id WHERE f.total > 0""",
)
def prescription_sale_invoices(r: Roles) -> DataFrame:
    return sale(r).tables["invoice"]


@registry.add(
    "low_stock_alerts",
    SALE
    + f"""
    , touched AS (SELECT d.drug_id, d.drug_name, CAST(d.quantity * 10 - sum(s.sold) AS BIGINT) AS current_qty FROM drugs d JOIN served s ON s.drug_id = d.drug_id GROUP BY d.drug_id, d.drug_name, d.quantity)
    SELECT coalesce(a.drug_id, t.drug_id) AS drug_id, coalesce(a.drug_name, t.drug_name) AS drug_name,
           coalesce(t.current_qty, a.quantity) AS current_qty,
           CASE WHEN t.drug_id IS NULL THEN '2001-01-01 00:00:00' ELSE '{NOW}' END AS alert_date
    FROM (SELECT * FROM drugs WHERE quantity < 5) a FULL JOIN touched t ON a.drug_id = t.drug_id
    WHERE t.current_qty IS NULL OR t.current_qty < 10""",
)
def low_stock_alerts(r: Roles) -> DataFrame:
    return sale(r).tables["low_stock_alerts"]


@registry.add(
    "low_stock",
    with_roles("drugs", f"SELECT drug_id, drug_name, quantity AS current_qty, '{NOW}' AS alert_date FROM drugs WHERE quantity < 10"),
)
def low_stock(r: Roles) -> DataFrame:
    return pharmacy.low_stock(r.drugs, moment(NOW))


RESTOCK = with_roles(
    "drugs", "alerts AS (SELECT drug_id, drug_name FROM drugs WHERE quantity < 10), bought AS (SELECT d.*, (d.cents * 7 + 5) // 10 AS cost FROM alerts a JOIN drugs d ON d.drug_id = a.drug_id)"
)


def restock(r: Roles):
    return pharmacy.restock_low(pharmacy.low_stock(r.drugs, moment(NOW)), r.drugs, moment(NOW))


@registry.add(
    "restock_low",
    RESTOCK
    + f"""
    SELECT drug_id, drug_name, 50 AS quantity, {amount('cost')} AS unit_cost, '2001-09-01' AS purchase_date, {amount('cost * 50')} AS total FROM bought""",
)
def restock_low(r: Roles) -> DataFrame:
    return restock(r).tables["drug_purchases"]


@registry.add(
    "restock_low_stock",
    RESTOCK + "\nSELECT drug_id, CASE WHEN quantity < 10 THEN quantity + 50 ELSE quantity END AS quantity FROM drugs",
)
def restock_low_stock(r: Roles) -> DataFrame:
    return restock(r).tables["pharmacy_drugs"].select("drug_id", "quantity")


@registry.add(
    "restock_low_report",
    RESTOCK
    + f"""
    SELECT drug_id, '• ' || drug_name || ' | Purchased: 50 | Unit Cost: ' || {amount_text('cost')} || ' | Total: ' || {amount_text('cost * 50')} AS line FROM bought""",
)
def restock_low_report(r: Roles) -> DataFrame:
    return restock(r).tables["report"]


@registry.add(
    "restock_low_message",
    RESTOCK
    + f"""
    SELECT count(*) AS purchases, CASE WHEN count(*) = 0 THEN 'No low-stock drugs found. Nothing to purchase.'
      ELSE 'Purchase completed successfully:' || chr(13) || chr(13) || string_agg('• ' || drug_name || ' | Purchased: 50 | Unit Cost: '
        || {amount_text('cost')} || ' | Total: ' || {amount_text('cost * 50')} || chr(13), '' ORDER BY drug_id) END AS message FROM bought""",
)
def restock_low_message(r: Roles) -> DataFrame:
    return restock(r).outcomes.select("purchases", "message")


ADD_DRUG = with_roles(
    "ev drugs",
    """asked AS (SELECT request_id, request_ts, 'DRUG ' || (emp_id // 12 * 37) AS drug_name, request_id % 90 AS quantity, cents FROM ev),
    t AS (SELECT a.*, EXISTS (SELECT 1 FROM drugs d WHERE lower(d.drug_name) = lower(a.drug_name)) AS known FROM asked a),
    w AS (SELECT *, row_number() OVER (PARTITION BY lower(drug_name) ORDER BY request_ts, request_id) AS place FROM t WHERE NOT known),
    n AS (SELECT *, row_number() OVER (ORDER BY request_ts, request_id) + (SELECT max(drug_id) FROM drugs) AS drug_id FROM w WHERE place = 1)""",
)


def new_drugs(r: Roles):
    asked = r.events.select(
        "request_id",
        "request_ts",
        F.concat(F.lit("DRUG "), (F.col("emp_id") / 12 * 37).cast("long").cast("string")).alias("drug_name"),
        F.col("event_type").alias("barcode"),
        (F.col("request_id") % 90).cast("int").alias("quantity"),
        F.col("amount").alias("unit_cost"),
        F.lit("2024-01-01").cast("date").alias("prod_date"),
        F.lit("2027-01-01").cast("date").alias("exp_date"),
    )
    return pharmacy.add_drugs(asked, r.drugs, moment(NOW))


@registry.add(
    "add_drug",
    ADD_DRUG
    + f"""
    SELECT t.request_id, n.drug_id IS NOT NULL AS accepted, coalesce(n.drug_id, -1) AS drug_id,
           CASE WHEN n.drug_id IS NOT NULL THEN '✅ Drug "' || t.drug_name || '" added successfully.' || chr(13) || 'Quantity: ' || t.quantity || chr(13)
                  || 'Purchase Price: ' || {amount_text('t.cents')} || chr(13) || 'Selling Price (approx): ' || (t.cents * 13 // 1000) || '.' || lpad(CAST(t.cents * 13 % 1000 AS VARCHAR), 3, '0') || '00'
                  || chr(13) || 'Purchase Date: 01/09/2001'
                ELSE '⚠ The drug "' || t.drug_name || '" already exists in the pharmacy.' END AS message
    FROM t LEFT JOIN n ON n.request_id = t.request_id""",
)
def add_drug(r: Roles) -> DataFrame:
    return new_drugs(r).outcomes.withColumns(or_minus_one("drug_id"))


@registry.add(
    "add_drug_table",
    ADD_DRUG
    + f"""
    SELECT drug_id, drug_name, quantity, {amount('cents')} AS price FROM drugs
    UNION ALL SELECT drug_id, drug_name, quantity, {amount('(cents * 13 + 5) // 10')} FROM n""",
)
def add_drug_table(r: Roles) -> DataFrame:
    return new_drugs(r).tables["pharmacy_drugs"].select("drug_id", "drug_name", "quantity", "price")


# --------------------------------------------------------------------- rooms


def wards(r: Roles) -> DataFrame:
    """Parts as rooms of the hospital's own types."""
    kinds = F.array(*[F.lit(k) for k in ("Normal", "VIP", "emergency", "ICU", "surgery", "Recovery")])
    kind = F.element_at(kinds, (F.col("p_size") % 6 + 1).cast("int"))
    return r.table("part").select(
        F.col("p_partkey").alias("room_id"), kind.alias("room_type"), money("p_retailprice").alias("price_per_day")
    )


@registry.add(
    "room_price_by_type",
    """SELECT p_partkey AS room_id, ['Normal', 'VIP', 'emergency', 'ICU', 'surgery', 'Recovery'][p_size % 6 + 1] AS room_type,
              CAST([1500, 3000, 1500, 5000, 10000, -1][p_size % 6 + 1] AS DOUBLE) AS price_per_day FROM part""",
)
def room_price_by_type(r: Roles) -> DataFrame:
    priced = rooms.price_by_type(wards(r))
    return priced.withColumn("price_per_day", F.coalesce("price_per_day", F.lit(-1).cast("decimal(10,2)")))


@registry.add("room_status_init", "SELECT p_partkey AS room_id, 'Available' AS status FROM part")
def room_status_init(r: Roles) -> DataFrame:
    return rooms.initial_status(r.room)


@registry.add(
    "room_payment",
    f"""SELECT l_orderkey, l_linenumber, {day('l_shipdate')} AS checkin, CAST(l_quantity AS BIGINT) - 3 AS nights,
               {amount('greatest(CAST(l_quantity AS BIGINT) - 3, 1) * CAST(round(l_extendedprice * 100) AS BIGINT)')} AS paid_money FROM lineitem""",
)
def room_payment_query(r: Roles) -> DataFrame:
    checkin = F.to_date("l_shipdate")
    nights = F.col("l_quantity").cast("int") - 3
    paid = room_payment(checkin, F.date_add(checkin, nights), money("l_extendedprice"))
    return r.table("lineitem").select(
        "l_orderkey", "l_linenumber", checkin.alias("checkin"), nights.alias("nights"), paid.alias("paid_money")
    )


ROOM_ADDS = with_roles(
    "ev room",
    """asked AS (SELECT request_id, request_ts, CASE WHEN event_type = 'view' THEN 'Economy' ELSE 'suite ' || (emp_id // 12) END AS room_type, cents - 200 AS price FROM ev),
    known AS (SELECT lower(room_type) AS k, arg_min(cents, room_id) AS cents FROM room GROUP BY 1),
    t AS (SELECT a.*, k.cents AS old FROM asked a LEFT JOIN known k ON k.k = lower(a.room_type)),
    s AS (SELECT lower(room_type) AS k, min((request_ts, request_id)) AS f, arg_min(price, (request_ts, request_id)) AS price FROM t WHERE old IS NULL AND price > 0 GROUP BY 1),
    f AS (SELECT t.*, coalesce(old, CASE WHEN (request_ts, request_id) >= s.f THEN s.price END) AS cents FROM t LEFT JOIN s ON s.k = lower(t.room_type)),
    n AS (SELECT request_id, row_number() OVER (ORDER BY request_ts, request_id) + (SELECT max(room_id) FROM room) AS room_id FROM f WHERE cents IS NOT NULL)""",
)


def room_adds(r: Roles):
    asked = r.events.select(
        "request_id",
        "request_ts",
        F.when(F.col("event_type") == "view", "Economy")
        .otherwise(F.concat(F.lit("suite "), (F.col("emp_id") / 12).cast("long").cast("string")))
        .alias("room_type"),
        (F.col("amount") - 2).cast("decimal(10,2)").alias("price_per_day"),
    )
    return rooms.add_rooms(asked, r.room, r.room_status)


@registry.add(
    "room_changes",
    ROOM_ADDS
    + f"""
    SELECT f.request_id, cents IS NOT NULL AS accepted, coalesce(n.room_id, -1) AS room_id,
           CASE WHEN cents IS NULL THEN '❌ Error: New room type detected. Please provide a valid price_per_day value.'
                ELSE '✅ Room "' || room_type || '" inserted successfully with price ' || {amount_text('cents')} || '.' END AS message
    FROM f LEFT JOIN n ON n.request_id = f.request_id""",
)
def room_changes(r: Roles) -> DataFrame:
    return room_adds(r).outcomes.withColumns(or_minus_one("room_id"))


@registry.add(
    "room_type_change",
    with_roles(
        "ev room",
        """asked AS (SELECT request_id, request_ts, request_id * 3 % 2500 AS room_id, CASE event_type WHEN 'error' THEN 'loft' WHEN 'view' THEN 'PROMO' ELSE 'large' END AS kind FROM ev)
        SELECT a.request_id, a.room_id, r.room_id IS NOT NULL AND kind <> 'loft' AS accepted,
               CASE WHEN r.room_id IS NULL THEN '❌ Room not found.' WHEN kind = 'loft' THEN '⚠ Room type not found. Please insert a room with this type first.'
                    ELSE '✅ Room type and price updated successfully.' END AS message
        FROM asked a LEFT JOIN room r ON r.room_id = a.room_id""",
    ),
)
def room_type_change(r: Roles) -> DataFrame:
    return rooms.change_room_type(room_type_requests(r), r.room).outcomes


def room_type_requests(r: Roles) -> DataFrame:
    kind = F.col("event_type")
    return r.events.select(
        "request_id",
        "request_ts",
        (F.col("request_id") * 3 % 2500).alias("room_id"),
        F.when(kind == "error", "loft").when(kind == "view", "PROMO").otherwise("large").alias("new_type"),
    )


@registry.add(
    "room_type_table",
    with_roles(
        "ev room",
        f"""asked AS (SELECT request_id, request_ts, request_id * 3 % 2500 AS room_id, CASE event_type WHEN 'error' THEN 'loft' WHEN 'view' THEN 'PROMO' ELSE 'large' END AS kind FROM ev),
        known AS (SELECT lower(room_type) AS k, arg_min(cents, room_id) AS cents FROM room GROUP BY 1),
        last AS (SELECT room_id, arg_max(kind, (request_ts, request_id)) AS kind FROM asked WHERE kind <> 'loft' GROUP BY 1)
        SELECT r.room_id, coalesce(l.kind, r.room_type) AS room_type, {amount('coalesce(k.cents, r.cents)')} AS price_per_day
        FROM room r LEFT JOIN last l ON l.room_id = r.room_id LEFT JOIN known k ON k.k = lower(l.kind)""",
    ),
)
def room_type_table(r: Roles) -> DataFrame:
    return rooms.change_room_type(room_type_requests(r), r.room).tables["room"]


# Room types asked for; the last one does not exist.
ASKED_KINDS = ("economy", "large", "medium", "promo", "small", "standard", "penthouse")


def room_requests(r: Roles) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ASKED_KINDS])
    return r.orders.select(
        "request_id",
        "request_ts",
        "p_id",
        F.element_at(kinds, ((F.col("request_id") * 5 + F.col("p_id")) % 7 + 1).cast("int")).alias("room_type"),
    )


def open_stays(r: Roles) -> DataFrame:
    """One segment of customers is in a room; the others have left theirs."""
    return r.table("customer").select(
        F.col("c_custkey").alias("reservation_id"),
        F.col("c_custkey").alias("p_id"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.lit("1995-01-01").cast("date")).alias("checkout"),
    )


def room_reservations(r: Roles):
    return rooms.reserve_room(
        room_requests(r), r.patient, r.room, r.room_status, open_stays(r), r.employee, r.emp_shift, r.order_shifts
    )


_CLOCK = "hour(a.request_ts) * 3600 + minute(a.request_ts) * 60 + second(a.request_ts)"
_DESK = """desk AS (SELECT s.start_time AS b, s.end_time AS e, min(m.emp_id) AS emp_id FROM order_shifts s JOIN emp_shift x ON x.shift_id = s.shift_id
            JOIN emp m ON m.emp_id = x.emp_id AND m.type = 'Receptionist' GROUP BY ALL)"""
# The limits per type are lowered until no line is longer than its rooms; limits only ever fall.
RESERVE = with_roles(
    "ord pat emp emp_shift order_shifts room room_status",
    f"""{_DESK},
    asked AS (SELECT a.request_id, a.request_ts, a.p_id, ['{"', '".join(ASKED_KINDS)}'][CAST((a.request_id * 5 + a.p_id) % 7 AS INTEGER) + 1] AS kind,
                     row_number() OVER (ORDER BY a.request_ts, a.request_id) AS pos, p.p_id IS NOT NULL AS known, c.c_custkey IS NOT NULL AS staying,
                     (SELECT min(emp_id) FROM desk WHERE {_CLOCK} BETWEEN b AND e) AS rec
              FROM ord a LEFT JOIN pat p ON p.p_id = a.p_id LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') c ON c.c_custkey = a.p_id),
    free AS (SELECT lower(r.room_type) AS kind, r.room_id, row_number() OVER (PARTITION BY lower(r.room_type) ORDER BY r.room_id) AS place
             FROM room r JOIN room_status s ON s.room_id = r.room_id WHERE lower(s.status) = 'available'),
    supply AS (SELECT kind, count(*) AS n FROM free GROUP BY 1),
    wish AS (SELECT p_id, a.kind, min(pos) AS pos, any_value(s.n) AS n FROM asked a JOIN supply s ON s.kind = a.kind WHERE known AND NOT staying AND rec IS NOT NULL GROUP BY 1, 2),
    rounds AS (
      SELECT 0 AS round, kind, CAST(1000000000 AS BIGINT) AS lim, true AS moved FROM supply
      UNION ALL
      SELECT round + 1, kind, least(lim, coalesce(cut, lim)), bool_or(coalesce(cut, lim) < lim) OVER () FROM (
        SELECT p.round, p.kind, p.lim, c.cut FROM (SELECT * FROM rounds WHERE moved) p LEFT JOIN (
          SELECT kind, max(pos) FILTER (WHERE place = n) AS cut FROM (
            SELECT kind, n, pos, row_number() OVER (PARTITION BY kind ORDER BY pos) AS place, count(*) OVER (PARTITION BY kind) AS total FROM (
              SELECT w.p_id, arg_min(w.kind, w.pos) AS kind, min(w.pos) AS pos, arg_min(w.n, w.pos) AS n FROM wish w JOIN rounds q ON q.kind = w.kind AND w.pos <= q.lim GROUP BY 1))
          WHERE total > n GROUP BY 1) c ON c.kind = p.kind)),
    lim AS (SELECT kind, min(lim) AS lim FROM rounds GROUP BY 1),
    line AS (SELECT w.p_id, arg_min(w.kind, w.pos) AS kind, min(w.pos) AS pos FROM wish w JOIN lim q ON q.kind = w.kind AND w.pos <= q.lim GROUP BY 1),
    won AS (SELECT l.*, f.room_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) AS place FROM line) l JOIN free f ON f.kind = l.kind AND f.place = l.place),
    made AS (SELECT *, row_number() OVER (ORDER BY pos) + (SELECT max(c_custkey) FROM customer) AS reservation_id FROM won)""",
    recursive=True,
)


@registry.add(
    "reserve_room",
    RESERVE
    + """
    SELECT a.request_id, m.pos = a.pos IS TRUE AS accepted, CASE WHEN m.pos = a.pos THEN m.room_id ELSE -1 END AS room_id,
           CASE WHEN m.pos = a.pos THEN m.reservation_id ELSE -1 END AS reservation_id,
           CASE WHEN m.pos = a.pos THEN '✅ Reservation added successfully. Room ID: ' || m.room_id || ', Reservation ID: ' || m.reservation_id
                WHEN NOT known THEN '❌ Invalid patient ID.'
                WHEN staying OR m.pos < a.pos THEN 'This Patient Is Reserved In Another Room Cant Reserve new Room'
                WHEN rec IS NULL THEN '❌ No receptionist available now.' ELSE '⚠ No available rooms of the selected type , All Reserved.' END AS message
    FROM asked a LEFT JOIN made m ON m.p_id = a.p_id""".replace("m.pos = a.pos IS TRUE", "coalesce(m.pos = a.pos, false)"),
)
def reserve_room(r: Roles) -> DataFrame:
    return room_reservations(r).outcomes.withColumns(or_minus_one("room_id", "reservation_id"))


def room_stays(r: Roles) -> DataFrame:
    """Orders as room stays; parts below the lowest supplier count are the rooms."""
    return r.table("orders").select(
        F.col("o_orderkey").alias("reservation_id"),
        money("o_totalprice", 12).alias("paid_money"),
        F.to_date("o_orderdate").alias("checkin"),
        F.lit(None).cast("date").alias("checkout"),
        F.col("o_custkey").alias("p_id"),
        (F.col("o_custkey") % 100).alias("room_id"),
    )


def checkouts(r: Roles):
    """Order lines pay for the stay of their order or the next hundred; numbers beyond do not exist."""
    asked = r.orders.select(
        "request_id",
        "request_ts",
        (F.col("request_id") + F.col("p_id") % 3 * 100).alias("reservation_id"),
        F.date_add("order_date", (F.col("request_id") % 40 - 5).cast("int")).alias("checkout"),
        "payment_method",
    )
    return rooms.room_checkout(
        asked, room_stays(r), r.room, r.room_status, r.employee, r.emp_shift, r.order_shifts, r.invoice
    )


CHECKOUT = with_roles(
    "ord emp_shift order_shifts room inv",
    f"""{_DESK},
    stay AS (SELECT o_orderkey AS reservation_id, CAST(o_orderdate AS DATE) AS checkin, o_custkey % 100 AS room_id, o_custkey AS p_id FROM orders),
    asked AS (SELECT a.*, request_id + p_id % 3 * 100 AS reservation_id, order_date + CAST(request_id % 40 - 5 AS INTEGER) AS checkout,
                     (SELECT min(emp_id) FROM desk WHERE {_CLOCK} BETWEEN b AND e) AS rec FROM ord a),
    t AS (SELECT a.request_id, a.request_ts, a.reservation_id, a.checkout, a.rec, a.payment_method, s.room_id, s.p_id, r.cents AS price,
                 greatest(datediff('day', s.checkin, a.checkout), 1) AS days,
                 CASE WHEN a.rec IS NULL THEN '❌ No receptionist available now.' WHEN r.room_id IS NULL THEN '⚠ Reservation not found.'
                      WHEN a.checkout < s.checkin THEN '⚠ Checkout date cannot be earlier than checkin date.' END AS refused
          FROM asked a LEFT JOIN stay s ON s.reservation_id = a.reservation_id LEFT JOIN room r ON r.room_id = s.room_id),
    made AS (SELECT *, row_number() OVER (ORDER BY request_ts, request_id) + (SELECT max(invoice_id) FROM inv) AS invoice_id FROM t WHERE refused IS NULL)""",
)


@registry.add(
    "room_checkout",
    CHECKOUT
    + f"""
    SELECT t.request_id, t.refused IS NULL AS accepted, coalesce(m.invoice_id, -1) AS invoice_id, {amount('coalesce(m.days * m.price, 0)')} AS amount,
           coalesce(t.refused, '✅ Checkout completed successfully. Total Paid = ' || {amount_text('m.days * m.price')}) AS message
    FROM t LEFT JOIN made m ON m.request_id = t.request_id""",
)
def room_checkout(r: Roles) -> DataFrame:
    out = checkouts(r).outcomes.withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(10,2)")))
    return out.withColumns(or_minus_one("invoice_id"))


@registry.add(
    "room_checkout_stays",
    CHECKOUT
    + f"""
    SELECT s.reservation_id, {day('l.checkout')} AS checkout, {amount('coalesce(l.paid, i.cents)')} AS paid_money FROM stay s JOIN inv i ON i.invoice_id = s.reservation_id
    LEFT JOIN (SELECT reservation_id, arg_max(checkout, (request_ts, request_id)) AS checkout, arg_max(days * price, (request_ts, request_id)) AS paid
               FROM made GROUP BY 1) l ON l.reservation_id = s.reservation_id""",
)
def room_checkout_stays(r: Roles) -> DataFrame:
    return checkouts(r).tables["room_reservation"].select("reservation_id", "checkout", "paid_money")


@registry.add(
    "room_checkout_lines",
    CHECKOUT
    + f"""
    SELECT invoice_id, reservation_id, 'Room' AS reservation_type, room_id AS process_id, {amount('price')} AS unit_price, days AS quantity,
           {amount('days * price')} AS total, 17 AS dept_id FROM made""",
)
def room_checkout_lines(r: Roles) -> DataFrame:
    return checkouts(r).tables["invoice_details"]


@registry.add(
    "room_status_drift",
    with_roles(
        "room_status",
        """occupied AS (SELECT DISTINCT c_custkey AS room_id FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
        SELECT s.room_id, s.status, o.room_id IS NOT NULL AS occupied FROM room_status s LEFT JOIN occupied o ON o.room_id = s.room_id
        WHERE (lower(s.status) = 'reserved') <> (o.room_id IS NOT NULL)""",
    ),
)
def room_status_drift(r: Roles) -> DataFrame:
    stays = r.table("customer").select(
        F.col("c_custkey").alias("room_id"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.lit("1995-01-01").cast("date")).alias("checkout"),
    )
    return rooms.room_status_drift(r.room_status, stays)
