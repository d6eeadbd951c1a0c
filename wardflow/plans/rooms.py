"""Rooms: prices, status, reservation, check-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.money import money, room_payment, stay_days
from wardflow.functions.text import folded, joined
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, first_per, flagged, turn
from wardflow.operators.scan import highest_id, number_rows, with_next_ids
from wardflow.operators.snapshots import append
from wardflow.plans.duty import with_receptionist
from wardflow.session import materialize

ROOM_DEPARTMENT = 17

# Default price per day by room type.
ROOM_PRICES = {"normal": 1500, "vip": 3000, "emergency": 1500, "icu": 5000, "surgery": 10000}

NO_RECEPTIONIST = "❌ No receptionist available now."


def price_by_type(room: DataFrame) -> DataFrame:
    """Set each room's default price; other types get none."""
    kind = F.lower("room_type")
    price = F.lit(None).cast("int")
    for name, amount in ROOM_PRICES.items():
        price = F.when(kind == name, F.lit(amount)).otherwise(price)
    return room.withColumn("price_per_day", money(price))


def initial_status(room: DataFrame) -> DataFrame:
    return room.select("room_id", F.lit("Available").alias("status"))


def _type_prices(room: DataFrame) -> DataFrame:
    """Price per room type, as held by its lowest room."""
    return room.groupBy(F.lower("room_type").alias("_type")).agg(
        F.min_by("price_per_day", "room_id").alias("_price")
    )


def add_rooms(requests: DataFrame, room: DataFrame, room_status: DataFrame) -> JobResult:
    """New rooms: a known type keeps its price, a new type needs one.

    The first request with a valid price settles a new type for the rest of the batch.
    """
    asked = requests.withColumn("_type", F.lower("room_type")).join(_type_prices(room), "_type", "left")
    settled = first_per(
        asked.filter(F.col("_price").isNull() & (F.col("price_per_day") > 0)), ["_type"], "price_per_day"
    ).select("_type", F.struct(*REQUEST_ORDER).alias("_from"), F.col("price_per_day").alias("_new_price"))
    asked = asked.join(settled, "_type", "left").withColumn(
        "price", money(F.coalesce("_price", F.when(turn() >= F.col("_from"), F.col("_new_price"))))
    )
    rows = with_next_ids(
        asked.filter("price is not null").drop("price_per_day").withColumnRenamed("price", "price_per_day"),
        room,
        "room_id",
        REQUEST_ORDER,
    )
    outcomes = asked.join(rows.select("request_id", "room_id"), "request_id", "left").select(
        "request_id",
        F.col("price").isNotNull().alias("accepted"),
        F.when(
            F.col("price").isNotNull(),
            joined(F.lit('✅ Room "'), "room_type", F.lit('" inserted successfully with price '), "price", F.lit(".")),
        )
        .otherwise("❌ Error: New room type detected. Please provide a valid price_per_day value.")
        .alias("message"),
        "room_id",
    )
    status = append(room_status, initial_status(rows))
    return JobResult(outcomes, {"room": append(room, rows), "room_status": status})


def change_room_type(requests: DataFrame, room: DataFrame) -> JobResult:
    """Give rooms another known type and its price; the last change per room counts."""
    known = room.select("room_id").withColumn("known", F.lit(True))
    asked = (
        requests.withColumn("_type", F.lower("new_type"))
        .join(known, "room_id", "left")
        .join(_type_prices(room), "_type", "left")
        .withColumn(
            "refused",
            first_failure(
                [
                    (F.col("known").isNull(), "❌ Room not found."),
                    (
                        F.col("_price").isNull(),
                        "⚠ Room type not found. Please insert a room with this type first.",
                    ),
                ]
            ),
        )
    )
    latest = asked.filter("refused is null").groupBy("room_id").agg(
        F.max(F.struct(*REQUEST_ORDER, "new_type", "_price")).alias("_new")
    )
    next_room = room.join(latest, "room_id", "left").withColumns(
        {
            "room_type": F.coalesce("_new.new_type", "room_type"),
            "price_per_day": F.coalesce("_new._price", "price_per_day"),
        }
    )
    outcomes = asked.select(
        "request_id",
        F.col("refused").isNull().alias("accepted"),
        F.coalesce("refused", F.lit("✅ Room type and price updated successfully.")).alias("message"),
        F.col("room_id").cast("long").alias("room_id"),
    )
    return JobResult(outcomes, {"room": next_room.select(*room.columns)})


def reserve_room(
    requests: DataFrame,
    patient: DataFrame,
    room: DataFrame,
    room_status: DataFrame,
    stays: DataFrame,
    employee: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
) -> JobResult:
    """Give each patient at most one room: the lowest free one of the type asked for.

    Requests are served in order and a patient refused for one type may get another
    type later. Which request of a patient counts is settled in rounds: everyone
    stands in line with the earliest request still open to them; a line longer than
    the free rooms of its type closes behind the last one served, and those behind
    move on to their next request. Once no line is too long the result equals serving
    the requests one by one.
    """
    open_stays = stays.filter("checkout is null").select("p_id").distinct()
    asked = flagged(requests, patient.select("p_id").distinct(), ["p_id"], "patient_known")
    asked = flagged(asked, open_stays, ["p_id"], "staying")
    asked = with_receptionist(asked, employee, emp_shift, dated, today_only=False)
    asked = materialize(asked.withColumn("_type", F.lower("room_type")), "asked")
    free = room.join(
        room_status.filter(F.lower("status") == "available").select("room_id"), "room_id", "left_semi"
    ).select("room_id", F.lower("room_type").alias("_type"))
    free = number_rows(free.filter("_type is not null"), ["room_id"], "place", keys=["_type"])
    supply = free.groupBy("_type").agg(F.count("*").alias("supply"))

    # Only a patient's first request per type can matter: if it comes too late, so do the others.
    wishes = (
        asked.filter("patient_known and not staying and receptionist_id is not null and _type is not null")
        .groupBy("p_id", "_type")
        .agg(F.min(turn()).alias("at"))
        .join(supply, "_type")
    )
    wishes = materialize(wishes, "wishes")
    closed = None
    while True:
        reachable = wishes
        if closed is not None:
            reachable = wishes.join(closed, "_type", "left").filter(
                F.col("last").isNull() | (F.col("at") <= F.col("last"))
            )
        line = reachable.groupBy("p_id").agg(F.min(F.struct("at", "_type", "supply")).alias("wish"))
        line = line.select("p_id", "wish.*").select("*", "at.*")
        placed = number_rows(line, list(REQUEST_ORDER), "place", keys=["_type"])
        full = (
            placed.groupBy("_type", "supply")
            .agg(F.max("place").alias("waiting"), F.max(F.when(F.col("place") == F.col("supply"), F.col("at"))).alias("last"))
            .filter("waiting > supply")
            .select("_type", "last")
        )
        full = materialize(full, "full")
        if full.isEmpty():
            break
        if closed is not None:
            full = materialize(full.unionByName(closed).groupBy("_type").agg(F.min("last").alias("last")), "closed")
        closed = full

    won = placed.join(free, ["_type", "place"]).select("request_id", "request_ts", "p_id", "room_id")
    made = with_next_ids(won, stays, "reservation_id", REQUEST_ORDER)
    served = made.select("p_id", turn().alias("_served"))
    outcomes = (
        asked.join(made.select("request_id", "room_id", "reservation_id"), "request_id", "left")
        .join(served, "p_id", "left")
        .select(
            "request_id",
            F.col("reservation_id").isNotNull().alias("accepted"),
            F.when(
                F.col("reservation_id").isNotNull(),
                joined(
                    F.lit("✅ Reservation added successfully. Room ID: "),
                    "room_id",
                    F.lit(", Reservation ID: "),
                    "reservation_id",
                ),
            )
            .otherwise(
                first_failure(
                    [
                        (~F.col("patient_known"), "❌ Invalid patient ID."),
                        (
                            F.col("staying") | (F.col("_served") < turn()),
                            "This Patient Is Reserved In Another Room Cant Reserve new Room",
                        ),
                        (F.col("receptionist_id").isNull(), NO_RECEPTIONIST),
                        (F.lit(True), "⚠ No available rooms of the selected type , All Reserved."),
                    ]
                )
            )
            .alias("message"),
            "room_id",
            "reservation_id",
        )
    )
    desk = asked.select("request_id", "receptionist_id")
    rows = made.join(desk, "request_id").select(
        "reservation_id",
        F.to_date("request_ts").alias("checkin"),
        F.lit(None).cast("date").alias("checkout"),
        "p_id",
        "room_id",
        F.col("receptionist_id").alias("emp_id"),
    )
    taken = made.select("room_id").withColumn("_taken", F.lit(True))
    status = room_status.join(taken, "room_id", "left").select(
        "room_id", F.when(F.col("_taken"), "Reserved").otherwise(F.col("status")).alias("status")
    )
    return JobResult(outcomes, {"room_reservation": rows, "room_status": status})


def room_checkout(
    requests: DataFrame,
    stays: DataFrame,
    room: DataFrame,
    room_status: DataFrame,
    employee: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    invoice: DataFrame,
) -> JobResult:
    """End stays, bill them and free the rooms.

    Nothing stops a second check-out of one stay: it bills again, and the last one
    decides what the stay shows.
    """
    stay = stays.select("reservation_id", "room_id", "checkin", "p_id").join(
        room.select("room_id", "price_per_day"), "room_id"
    )
    asked = with_receptionist(requests, employee, emp_shift, dated, today_only=False)
    asked = asked.join(stay, "reservation_id", "left").withColumn(
        "refused",
        first_failure(
            [
                (F.col("receptionist_id").isNull(), NO_RECEPTIONIST),
                (F.col("room_id").isNull(), "⚠ Reservation not found."),
                (F.col("checkout") < F.col("checkin"), "⚠ Checkout date cannot be earlier than checkin date."),
            ]
        ),
    )
    asked = materialize(asked, "asked")
    billed = asked.filter("refused is null").withColumns(
        {
            "days": stay_days("checkin", "checkout"),
            "amount": room_payment("checkin", "checkout", "price_per_day"),
        }
    )
    made = with_next_ids(billed, invoice, "invoice_id", REQUEST_ORDER)
    outcomes = asked.join(made.select("request_id", "invoice_id", "amount"), "request_id", "left").select(
        "request_id",
        F.col("refused").isNull().alias("accepted"),
        F.coalesce(
            "refused", joined(F.lit("✅ Checkout completed successfully. Total Paid = "), "amount")
        ).alias("message"),
        "invoice_id",
        "amount",
    )
    latest = made.groupBy("reservation_id").agg(
        F.max(F.struct(*REQUEST_ORDER, "checkout", "amount")).alias("_last")
    )
    ended = stays.join(latest, "reservation_id", "left").select(
        *[
            F.coalesce(F.col("_last.checkout").cast(f.dataType), F.col("checkout")).alias("checkout")
            if f.name == "checkout"
            else F.coalesce(F.col("_last.amount").cast(f.dataType), F.col("paid_money")).alias("paid_money")
            if f.name == "paid_money"
            else F.col(f.name)
            for f in stays.schema
        ]
    )
    freed = made.select("room_id").distinct().withColumn("_freed", F.lit(True))
    status = room_status.join(freed, "room_id", "left").select(
        "room_id", F.when(F.col("_freed"), "Available").otherwise(F.col("status")).alias("status")
    )
    headers = made.select(
        "invoice_id",
        F.to_date("request_ts").alias("date"),
        "payment_method",
        F.col("amount").alias("paid_money"),
        "p_id",
        F.col("receptionist_id").alias("emp_id"),
    )
    lines = made.select(
        "invoice_id",
        "reservation_id",
        F.lit("Room").alias("reservation_type"),
        F.col("room_id").alias("process_id"),
        F.col("price_per_day").alias("unit_price"),
        F.col("days").alias("quantity"),
        F.col("amount").alias("total"),
        F.lit(ROOM_DEPARTMENT).alias("dept_id"),
    )
    return JobResult(
        outcomes, {"room_reservation": ended, "room_status": status, "invoice": headers, "invoice_details": lines}
    )


def room_status_drift(room_status: DataFrame, stays: DataFrame) -> DataFrame:
    """Rooms marked reserved without an open stay, or with one but not marked."""
    occupied = stays.filter("checkout is null").select("room_id").distinct()
    checked = flagged(room_status, occupied, ["room_id"], "occupied")
    reserved = folded("status") == "reserved"
    return checked.filter(reserved != F.col("occupied")).select("room_id", "status", "occupied")
