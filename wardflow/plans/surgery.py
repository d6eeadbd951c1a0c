"""Operating-room scheduling, cancellation and load reports."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.clock import clock_text, date_text
from wardflow.functions.money import money
from wardflow.functions.text import folded, joined, same_text
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, flagged
from wardflow.operators.intervals import self_conflicts
from wardflow.operators.scan import fold, highest_id, with_next_ids
from wardflow.plans.duty import with_receptionist
from wardflow.session import materialize

SURGERY_DEPARTMENT = 11
ROOM_DEPARTMENT = 17
OPENING = 7 * 3600
PREPARATION_MINUTES = 60
RECOVERY_MINUTES = 60
DAY = 86_400

NO_ROOM = "? No available operating rooms for the selected date."
NO_RECOVERY = "? No available recovery rooms for the selected date."
NO_TEAM = "? No available staff for the selected date/time."
BUSY = {
    "auto": "? Patient or doctor already have a surgery at this time.",
    "manual": "❌ Doctor or Patient already has a surgery at this time.",
}
TEAM_BUSY = "❌ Staff already assigned to another surgery at this time."

PLACED = "request_id long, surgery_date date, refused string, room_id long, recovery_room_id long, team_id long, start_s long, end_s long"


def surgery_conflicts(surgeries: DataFrame) -> DataFrame:
    """Reservations that share a doctor, patient, room or team with another one at an
    overlapping time of the same date, one flag column per kind."""
    out = surgeries.select("reservation_id")
    flags = []
    for kind, column in (("doctor", "doctor_id"), ("patient", "p_id"), ("room", "room_id"), ("team", "stuff_id")):
        slots = surgeries.filter(F.col(column).isNotNull()).select(
            "surgery_date", column, "start_time", "end_time", "reservation_id"
        )
        hits = self_conflicts(slots, ["surgery_date", column], "start_time", "end_time", "reservation_id")
        flags.append(f"{kind}_conflict")
        out = flagged(out, hits, ["reservation_id"], f"{kind}_conflict")
    return out.filter(" or ".join(flags))


def or_next_available(room: DataFrame, surgeries: DataFrame, date: Column) -> DataFrame:
    """Operating rooms of one date with the time they are free again; the earliest first."""
    last = surgeries.filter(F.col("surgery_date") == date).groupBy("room_id").agg(F.max("end_time").alias("_end"))
    free_at = (F.col("_end") + PREPARATION_MINUTES * 60) % DAY
    return (
        room.filter(same_text("room_type", "surgery"))
        .select("room_id")
        .join(last, "room_id", "left")
        .select("room_id", F.coalesce(free_at, F.lit(OPENING)).cast("long").alias("next_available"))
        .orderBy("next_available", "room_id")
    )


def _days_around(checkin: str, checkout: str) -> tuple[Column, Column]:
    """First and last date on which a stay counts: begun at most an hour after its midnight, not over before it."""
    soon = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(RECOVERY_MINUTES))
    instant = F.col(checkin).cast("timestamp_ntz") - soon - F.expr("INTERVAL '0.000001' SECOND")
    return F.date_add(instant.cast("date"), 1), F.col(checkout).cast("date")


def recovery_load(room: DataFrame, stays: DataFrame, date: Column) -> DataFrame:
    """Stays per recovery room around one date; the least loaded first."""
    first, last = _days_around("checkin", "checkout")
    around = stays.filter(date.cast("date").between(first, last)).groupBy("room_id").agg(F.count("*").alias("n"))
    return (
        room.filter(same_text("room_type", "recovery"))
        .select("room_id")
        .join(around, "room_id", "left")
        .select("room_id", F.coalesce("n", F.lit(0)).alias("reservations_count"))
        .orderBy("reservations_count", "room_id")
    )


def recovery_loads(dates: DataFrame, room: DataFrame, stays: DataFrame) -> DataFrame:
    """Stays per (date, recovery room) for many dates at once; rooms without any on a date are left out.

    A stay becomes a row for each of its days between the first and the last date asked for, and only
    days asked for are counted.
    """
    asked = dates.select("surgery_date").distinct()
    first, last = _days_around("checkin", "checkout")
    spans = (
        stays.filter("checkin is not null and checkout is not null")
        .join(room.filter(same_text("room_type", "recovery")).select("room_id"), "room_id", "left_semi")
        .select(
            "room_id",
            F.greatest(first, asked.agg(F.min("surgery_date")).scalar()).alias("_from"),
            F.least(last, asked.agg(F.max("surgery_date")).scalar()).alias("_to"),
        )
        .filter("_from <= _to")
    )
    days = spans.select("room_id", F.explode(F.sequence("_from", "_to")).alias("surgery_date"))
    return days.join(asked, "surgery_date", "left_semi").groupBy("surgery_date", "room_id").agg(F.count("*").alias("load"))


def recovery_loads_everywhere(dates: DataFrame, room: DataFrame, stays: DataFrame) -> DataFrame:
    """Stays for every date and every recovery room, 0 where there are none."""
    rooms = room.filter(same_text("room_type", "recovery")).select("room_id")
    asked = dates.select("surgery_date").distinct().crossJoin(rooms)
    loads = recovery_loads(dates, room, stays)
    return asked.join(loads, ["surgery_date", "room_id"], "left").withColumn("load", F.coalesce("load", F.lit(0).cast("long")))


def _touches(start: int, end: int, other_start: int, other_end: int) -> bool:
    """Inclusive overlap; also defined for an end that passed midnight."""
    return (
        other_start <= start <= other_end or other_start <= end <= other_end or start <= other_start <= end
    )


class _Day:
    """What is taken on one date, while its requests are served in order."""

    def __init__(self, mode: str, rooms: list[int], recovery: list[int], teams: list[int], wrap: bool):
        self.mode, self.teams, self.wrap = mode, teams, wrap
        self.taken: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)
        self.rooms = rooms
        # Rooms by the time they are free, and recovery rooms by their load; entries that changed are outdated.
        self.free = dict.fromkeys(rooms, OPENING)
        self.by_free = [(OPENING, room) for room in rooms]
        self.load = dict.fromkeys(recovery, 0)
        self.by_load = [(0, room) for room in recovery]

    def take(self, kind: str, key: int, start: int, end: int) -> None:
        if kind == "recovery":
            self.load[key] = self.load.get(key, 0) + start
            heappush(self.by_load, (self.load[key], key))
            return
        self.taken[kind, key].append((start, end))
        if kind == "room":
            at = max(e for _, e in self.taken[kind, key]) + PREPARATION_MINUTES * 60
            self.free[key] = at % DAY if self.wrap else at
            heappush(self.by_free, (self.free[key], key))

    def is_busy(self, kind: str, key: int, start: int, end: int) -> bool:
        return any(_touches(start, end, *slot) for slot in self.taken.get((kind, key), ()))

    def first_free(self) -> tuple[int, int]:
        while self.by_free[0][0] != self.free[self.by_free[0][1]]:
            heappop(self.by_free)
        return self.by_free[0]

    def least_loaded(self) -> int | None:
        while self.by_load and self.by_load[0][0] != self.load[self.by_load[0][1]]:
            heappop(self.by_load)
        return self.by_load[0][1] if self.by_load else None

    def serve(self, request: dict) -> dict:
        """The answer to a request; an accepted one takes its room, people and recovery room."""
        doctor, patient, team = request["doc_id"], request["p_id"], request["stuff_id"]
        out = {"request_id": request["request_id"], "surgery_date": request["surgery_date"]}
        room, start = None, request["start_time"]
        if not self.rooms:
            return out | {"refused": NO_ROOM}
        if start is None:
            start, room = self.first_free()
        else:
            # The end of the new surgery is not known yet at this point, so only a
            # start inside an existing slot rules a room out.
            held = (r for r in self.rooms if not any(s <= start <= e for s, e in self.taken.get(("room", r), ())))
            room = next(held, None)
            if room is None:
                return out | {"refused": NO_ROOM}
        end = start + request["duration"] * 60
        if self.wrap:
            end %= DAY
        elif end > DAY:
            return out | {"refused": NO_ROOM}
        if self.is_busy("doctor", doctor, start, end) or self.is_busy("patient", patient, start, end):
            return out | {"refused": BUSY[self.mode]}
        if team is not None:
            if self.mode == "manual" and self.is_busy("team", team, start, end):
                return out | {"refused": TEAM_BUSY}
        elif self.mode == "auto":
            team = next((t for t in self.teams if not self.is_busy("team", t, start, end)), None)
        if team is None:
            # A manual request has to name its team.
            return out | {"refused": NO_TEAM}
        recovery = self.least_loaded()
        if recovery is None:
            return out | {"refused": NO_RECOVERY}
        for kind, key in (("room", room), ("doctor", doctor), ("patient", patient), ("team", team)):
            self.take(kind, key, start, end)
        self.take("recovery", recovery, 1, 0)
        return out | {"room_id": room, "recovery_room_id": recovery, "team_id": team, "start_s": start, "end_s": end}


def _busy_times(surgeries: DataFrame, requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """Busy time of the requested dates by room, team, doctor and patient, as disjoint intervals.

    Of doctors and patients only those in the requests are kept, of rooms only operating rooms. Slots
    of one start are combined first, so what a window sorts is at most the seconds of a day; slots
    that touch become one. Slots over midnight stay as they are.
    """
    slots = surgeries.join(requests.select("surgery_date").distinct(), "surgery_date", "left_semi")

    def kind(name: str, column: str, only: DataFrame | None) -> DataFrame:
        rows = slots if only is None else slots.join(only, [c for c in only.columns], "left_semi")
        return rows.filter(F.col(column).isNotNull()).select(
            "surgery_date",
            F.lit(name).alias("kind"),
            F.col(column).cast("long").alias("key"),
            F.col("start_time").cast("long").alias("start_s"),
            F.col("end_time").cast("long").alias("end_s"),
        )

    doctors = requests.select("surgery_date", F.col("doc_id").alias("doctor_id")).distinct()
    patients = requests.select("surgery_date", "p_id").distinct()
    taken = (
        kind("room", "room_id", rooms.select("room_id"))
        .unionByName(kind("team", "stuff_id", None))
        .unionByName(kind("doctor", "doctor_id", doctors))
        .unionByName(kind("patient", "p_id", patients))
    )
    of = ["surgery_date", "kind", "key"]
    over = taken.filter("end_s < start_s").distinct()
    longest = taken.filter("start_s <= end_s").groupBy(*of, "start_s").agg(F.max("end_s").alias("end_s"))
    line = Window.partitionBy(*of).orderBy("start_s")
    reach = F.max("end_s").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.sum(F.when(reach >= F.col("start_s"), 0).otherwise(1)).over(line)
    merged = longest.withColumn("_reach", reach).withColumn("_island", apart)
    joined_up = merged.groupBy(*of, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return joined_up.drop("_island").unionByName(over)


def _place_all(
    requests: DataFrame,
    surgeries: DataFrame,
    room: DataFrame,
    stays: DataFrame,
    teams: DataFrame,
    mode: str,
    wrap: bool,
) -> DataFrame:
    """Place the requests of every date in order.

    Dates do not depend on each other, but a date's requests do: each takes what those before it left.
    They pass through a task in order (``scan.fold``), behind the busy times of their date. The task
    holds what is taken on the date, which the rooms and the people asked for bound, not the requests.
    """
    operating = room.filter(same_text("room_type", "surgery"))
    recovering = room.filter(same_text("room_type", "recovery"))
    loads = recovery_loads(requests, room, stays)
    busy = _busy_times(surgeries, requests, operating).unionByName(
        loads.select(
            "surgery_date",
            F.lit("recovery").alias("kind"),
            F.col("room_id").cast("long").alias("key"),
            F.col("load").alias("start_s"),
            F.lit(0).cast("long").alias("end_s"),
        )
    )
    ahead = materialize(busy, "busy")
    # No date can need more rooms or teams than those it uses already plus one for each request.
    used = ahead.groupBy("surgery_date", "kind").agg(F.count_distinct("key").alias("n")).groupBy("surgery_date").agg(F.max("n").alias("n"))
    counts = requests.groupBy("surgery_date").agg(F.count("*").alias("_asked")).join(used, "surgery_date", "left")
    most = counts.agg(F.max(F.col("_asked") + F.coalesce("n", F.lit(0)))).first()[0] or 0
    lists = [_lowest(df, c, most) for df, c in ((operating, "room_id"), (recovering, "room_id"), (teams, "stuff_id"))]
    shared = requests.sparkSession.sparkContext.broadcast(lists)

    def start(row: dict) -> _Day:
        return _Day(mode, *shared.value, wrap)

    def step(day: _Day, row: dict) -> tuple[_Day, dict | None]:
        if row["kind"] is None:
            return day, day.serve(row)
        day.take(row["kind"], row["key"], row["start_s"], row["end_s"])
        return day, None

    asked = requests.select(
        F.lit(1).alias("_turn"), *REQUEST_ORDER, "surgery_date", *[F.col(c).cast("long").alias(c) for c in ("p_id", "doc_id")], "stuff_id", "start_time", "duration"
    )
    line = asked.unionByName(ahead.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    return materialize(fold(line, ["surgery_date"], ["_turn", *REQUEST_ORDER], start, step, lambda *_: None, PLACED), "placed")


def _lowest(df: DataFrame, column: str, n: int) -> list[int]:
    return [int(row[0]) for row in df.select(column).distinct().orderBy(column).limit(n).collect()]


def schedule_surgery(
    requests: DataFrame,
    employee: DataFrame,
    surgery: DataFrame,
    room: DataFrame,
    teams: DataFrame,
    surgeries: DataFrame,
    stays: DataFrame,
    emp_shift: DataFrame,
    dated: DataFrame,
    invoice: DataFrame,
    mode: str = "auto",
    wrap_midnight: bool = False,
    room_status: DataFrame | None = None,
) -> JobResult:
    """Schedule surgeries with operating room, team and recovery room, and bill them.

    With ``room_status`` its next state is returned too: rooms given are reserved.

    ``auto`` finds the room that is free first and refuses today and Fridays;
    ``manual`` takes start time and team from the request. Canceled surgeries still
    block their slot. A surgery that would end after midnight is refused unless
    ``wrap_midnight`` lets its end time start over.
    """
    doctors = employee.filter(same_text("type", "consultant_doctor")).select(F.col("emp_id").alias("doc_id"))
    kinds = surgery.groupBy(folded("surgery_name").alias("_surgery")).agg(
        F.min(F.struct("surgery_id", "duration", "price")).alias("_kind")
    )
    if mode == "auto":
        past = F.col("surgery_date").cast("timestamp_ntz") < F.col("request_ts")
    else:
        past = F.col("surgery_date") < F.to_date("request_ts")
    asked = flagged(requests, doctors.distinct(), ["doc_id"], "consultant")
    asked = with_receptionist(asked, employee, emp_shift, dated, today_only=False)
    asked = asked.withColumn("_surgery", folded("surgery_name")).join(kinds, "_surgery", "left")
    rules = [
        (~F.col("consultant"), "? The selected doctor is either not found or not a consultant doctor."),
        (past, "? Cannot schedule surgery in the past."),
    ]
    if mode == "auto":
        friday = F.date_format("surgery_date", "EEEE") == "Friday"
        rules.append((friday, "? Cannot schedule surgery on Friday. Staff is unavailable."))
    rules += [
        (F.col("receptionist_id").isNull(), "? No receptionist available now."),
        (F.col("_kind").isNull(), "? Surgery not found."),
    ]
    asked = materialize(
        asked.withColumn("refused", first_failure(rules)).select(
            *requests.columns,
            "receptionist_id",
            F.col("_kind.surgery_id").alias("surgery_id"),
            F.col("_kind.duration").alias("duration"),
            F.col("_kind.price").alias("surgery_price"),
            "refused",
        ),
        "surgery",
    )
    start = F.col("start_time") if "start_time" in requests.columns else F.lit(None).cast("int")
    open_requests = asked.filter("refused is null").select(
        *REQUEST_ORDER,
        "surgery_date",
        "p_id",
        "doc_id",
        F.col("stuff_id").cast("long").alias("stuff_id"),
        start.cast("long").alias("start_time"),
        F.col("duration").cast("long").alias("duration"),
    )
    placed = _place_all(open_requests, surgeries, room, stays, teams, mode, wrap_midnight)
    prices = room.select("room_id", F.coalesce("price_per_day", F.lit(0)).alias("_price"))
    accepted = (
        placed.filter("refused is null")
        .drop("refused", "surgery_date")
        .join(asked.drop("start_time", "refused"), "request_id")
        .join(prices.withColumnRenamed("_price", "or_price"), "room_id")
        .join(
            prices.select(F.col("room_id").alias("recovery_room_id"), F.col("_price").alias("recovery_price")),
            "recovery_room_id",
        )
    )
    made = with_next_ids(accepted, surgeries, "reservation_id", REQUEST_ORDER).withColumn(
        "paid_total", money(F.col("surgery_price") + F.col("or_price") + F.col("recovery_price"), 14)
    )
    made = made.withColumn(
        "invoice_id",
        F.col("reservation_id") - highest_id(surgeries, "reservation_id") + highest_id(invoice, "invoice_id"),
    )
    success = joined(
        F.lit("? Surgery scheduled: "),
        date_text("surgery_date"),
        F.lit(" from "),
        clock_text("start_s"),
        F.lit(" to "),
        clock_text("end_s"),
        F.lit(". OR Room: "),
        "room_id",
        F.lit(", Recovery Room: "),
        "recovery_room_id",
        F.lit(". Reservation ID: "),
        "reservation_id",
    )
    outcomes = (
        asked.select("request_id", F.col("refused").alias("_guard"))
        .join(placed.select("request_id", "refused"), "request_id", "left")
        .join(
            made.select("request_id", success.alias("_success"), "reservation_id", "room_id", "start_s", "end_s"),
            "request_id",
            "left",
        )
        .select(
            "request_id",
            F.col("reservation_id").isNotNull().alias("accepted"),
            F.coalesce("_guard", "refused", "_success").alias("message"),
            "reservation_id",
        )
    )
    tables = _surgery_tables(made)
    if room_status is not None:
        given = tables["reserved_rooms"].withColumn("_given", F.lit(True))
        status = F.when(F.col("_given"), F.lit("reserved")).otherwise(F.col("status"))
        tables["room_status"] = room_status.join(given, "room_id", "left").withColumn("status", status).drop("_given")
    return JobResult(outcomes, tables)


def _surgery_tables(made: DataFrame) -> dict[str, DataFrame]:
    midnight = F.col("surgery_date").cast("timestamp_ntz")

    def later(minutes: Column) -> Column:
        return midnight + F.make_dt_interval(F.lit(0), F.lit(0), minutes)

    ends = F.col("duration").cast("int") + PREPARATION_MINUTES
    stay = ["p_id", F.col("receptionist_id").alias("emp_id")]
    operating = made.select(
        F.col("or_price").alias("paid_money"),
        midnight.alias("checkin"),
        later(ends).alias("checkout"),
        "room_id",
        *stay,
        F.lit("reserved_for_surgery").alias("status"),
    )
    recovering = made.select(
        F.col("recovery_price").alias("paid_money"),
        later(ends).alias("checkin"),
        later(ends + RECOVERY_MINUTES).alias("checkout"),
        F.col("recovery_room_id").alias("room_id"),
        *stay,
        F.lit("reserved_for_recovery").alias("status"),
    )
    # One pass over the bookings gives the three invoice lines of each.
    entries = F.array(
        *[
            F.struct(
                F.lit(kind).alias("reservation_type"),
                F.col(process).cast("long").alias("process_id"),
                money(price, 12).alias("unit_price"),
                F.lit(dept).alias("dept_id"),
            )
            for kind, process, price, dept in (
                ("Surgery", "surgery_id", "surgery_price", SURGERY_DEPARTMENT),
                ("Operating Room", "room_id", "or_price", ROOM_DEPARTMENT),
                ("Recovery Room", "recovery_room_id", "recovery_price", ROOM_DEPARTMENT),
            )
        ]
    )
    lines = made.select("invoice_id", "reservation_id", F.explode(entries).alias("line")).select(
        "invoice_id",
        "reservation_id",
        "line.reservation_type",
        "line.process_id",
        "line.unit_price",
        F.lit(1).alias("quantity"),
        F.col("line.unit_price").alias("total"),
        "line.dept_id",
    )
    return {
        "surgery_reservation": made.select(
            "reservation_id",
            "surgery_date",
            F.col("start_s").alias("start_time"),
            F.col("end_s").alias("end_time"),
            F.col("surgery_price").alias("paid_money"),
            "p_id",
            F.col("doc_id").alias("doctor_id"),
            "receptionist_id",
            "surgery_id",
            "room_id",
            F.col("team_id").alias("stuff_id"),
            F.lit("scheduled").alias("status"),
        ),
        "room_reservation": operating.unionByName(recovering),
        "reserved_rooms": made.select("room_id").union(made.select("recovery_room_id")).distinct(),
        "invoice": made.select(
            "invoice_id",
            F.to_date("request_ts").alias("date"),
            "payment_method",
            F.col("paid_total").alias("paid_money"),
            "p_id",
            F.col("receptionist_id").alias("emp_id"),
        ),
        "invoice_details": lines,
    }


# Invoice line types and stay states that belong to a surgery.
SURGERY_LINE_TYPES = ("surgery", "operating room", "recovery room")
SURGERY_STAY_STATES = ("reserved_for_surgery", "reserved_for_recovery")


def cancel_surgery(
    requests: DataFrame,
    surgeries: DataFrame,
    stays: DataFrame,
    room_status: DataFrame,
    invoice: DataFrame,
    details: DataFrame,
    compat: bool = True,
) -> JobResult:
    """Cancel surgeries, the patient's surgery stays from that date on, and the billing.

    Rooms are freed only for surgeries still to come at ``request_ts``. In the
    compatible form invoice lines of *every* kind with that reservation id go;
    otherwise only the surgery's own lines. Invoices without any line go as well.
    """
    found = requests.join(
        surgeries.select("reservation_id", "surgery_date", "start_time", "p_id"), "reservation_id"
    )
    asked = flagged(requests, surgeries.select("reservation_id"), ["reservation_id"], "found")
    outcomes = asked.select(
        "request_id",
        F.col("found").alias("accepted"),
        F.when(
            F.col("found"),
            "✅ Surgery reservation canceled successfully. Related rooms freed, invoice details deleted, and paid money set to 0.",
        )
        .otherwise("❌ Reservation not found.")
        .alias("message"),
    )
    gone = found.select("reservation_id").distinct()
    surgery_off = flagged(surgeries, gone, ["reservation_id"], "_off")
    zero = F.lit(0)
    next_surgeries = surgery_off.select(
        *[
            F.when(F.col("_off"), "canceled").otherwise(F.col(f.name)).alias(f.name)
            if f.name == "status"
            else F.when(F.col("_off"), zero).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name == "paid_money"
            else F.col(f.name)
            for f in surgeries.schema
        ]
    )
    clock = F.hour("request_ts") * 3600 + F.minute("request_ts") * 60 + F.second("request_ts")
    today = F.to_date("request_ts")
    ahead = (F.col("surgery_date") > today) | ((F.col("surgery_date") == today) & (F.col("start_time") > clock))
    per_patient = found.groupBy("p_id").agg(
        F.min("surgery_date").alias("_from"), F.min(F.when(ahead, F.col("surgery_date"))).alias("_free_from")
    )
    touched = stays.join(per_patient, "p_id", "left")
    off = F.coalesce(
        (F.col("checkin") >= F.col("_from")) & folded("status").isin(*SURGERY_STAY_STATES), F.lit(False)
    )
    touched = touched.withColumn("_off", off)
    next_stays = touched.select(
        *[
            F.when(F.col("_off"), "canceled").otherwise(F.col(f.name)).alias(f.name)
            if f.name == "status"
            else F.when(F.col("_off"), zero).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name == "paid_money"
            else F.col(f.name)
            for f in stays.schema
        ]
    )
    freed = touched.filter(
        (F.col("checkin") >= F.col("_free_from")) & (F.col("_off") | (folded("status") == "canceled"))
    ).select("room_id").distinct()
    next_status = flagged(room_status, freed, ["room_id"], "_freed").select(
        "room_id", F.when(F.col("_freed"), "available").otherwise(F.col("status")).alias("status")
    )
    lines = flagged(details, gone, ["reservation_id"], "_off")
    dropped = F.col("_off") if compat else F.col("_off") & folded("reservation_type").isin(*SURGERY_LINE_TYPES)
    next_details = lines.filter(~dropped).select(*details.columns)
    anything = gone.limit(1).agg(F.count("*")).scalar() > 0
    kept = flagged(invoice, next_details.select("invoice_id").distinct(), ["invoice_id"], "_lined")
    next_invoice = kept.filter(F.col("_lined") | ~anything).select(*invoice.columns)
    return JobResult(
        outcomes,
        {
            "surgery_reservation": next_surgeries,
            "room_reservation": next_stays,
            "room_status": next_status,
            "invoice_details": next_details,
            "invoice": next_invoice,
        },
    )


def orphan_invoices(invoice: DataFrame, details: DataFrame) -> DataFrame:
    """Invoices without a line."""
    return invoice.join(details.select("invoice_id"), "invoice_id", "left_anti")

