"""Streams over several files, one file per micro-batch, against the batch result."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tests.frames import D, TS, frame, rows, table
from wardflow.functions.clock import moment
from wardflow.plans import pharmacy
from wardflow.streaming import attendance, operations
from wardflow.streaming.state import AppendedTable, VersionedTable, to_folder


def files(spark, folder, parts, ddl):
    """One Parquet file per part, and the file stream over them."""
    for i, part in enumerate(parts):
        frame(spark, part, ddl).coalesce(1).write.parquet(f"{folder}/in/p{i:03d}")
    schema = frame(spark, parts[0], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_first_check_in_per_day_across_batches(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(b * 100 + i, rng.choice([1, 1, 1, 2, 3]), TS(2024, 1, 10 + b // 2, 8, i)) for i in range(40)] for b in range(4)]
    stream = files(spark, tmp_path, parts, "request_id int, emp_id int, ts timestamp")
    out = attendance.first_check_ins(stream)
    to_folder(out.select("emp_id", "attend_date"), f"{tmp_path}/out", f"{tmp_path}/state")
    found = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert found == sorted({(e, ts.date()) for p in parts for _, e, ts in p})


def test_missing_check_outs_appear_after_the_deadline(spark, tmp_path):
    people = frame(spark, [(1, "Doctor"), (2, "nurse"), (3, "nurse"), (4, "nurse")], "emp_id int, type string")
    weekly = table(spark, "doctor_appointments", [dict(id=1, examination_price=1, day="Wednesday", shift_start=28800, shift_end=57600, emp_id=1, dept_id=1)])
    dated = table(spark, "shift_appointment", [dict(shift_id=1, shift_type="x", date=D(2024, 1, 10), start_time=28800, end_time=57600)])
    emp_shift = table(spark, "emp_shift", [dict(emp_id=e, shift_id=1) for e in (2, 3)])
    ins = [[(e, TS(2024, 1, 10, 9)) for e in (1, 2, 3, 4)], [(9, TS(2024, 1, 14, 9))]]
    outs = [[(1, TS(2024, 1, 10, 15)), (2, TS(2024, 1, 10, 16, 31))], [(9, TS(2024, 1, 14, 9))]]
    ddl = "emp_id int, ts timestamp"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    pairs = attendance.pair_check_outs(files(spark, tmp_path / "a", ins, ddl), files(spark, tmp_path / "b", outs, ddl), people, weekly, dated, emp_shift)
    to_folder(pairs, f"{tmp_path}/out", f"{tmp_path}/state")
    settled = attendance.settled_days(spark.read.schema(pairs.schema).parquet(f"{tmp_path}/out"))
    assert rows(settled, "emp_id", "checkout", "missing") == [(1, TS(2024, 1, 10, 15), False), (2, None, True), (3, None, True)]


def test_stock_carries_over_between_batches(spark, tmp_path):
    rng = random.Random(2)
    parts = [[(b * 10 + i, TS(2024, 1, 10, b, i), b * 10 + i, f"drug {rng.randrange(3)}", rng.randrange(1, 9)) for i in range(8)] for b in range(3)]
    stream = files(spark, tmp_path, parts, "request_id int, request_ts timestamp_ntz, prescription_id int, drug_name string, req_qty int")
    drugs = table(spark, "pharmacy_drugs", [dict(drug_id=i, drug_name=f"Drug {i}", quantity=20 + i, exp_date=D(2030, 1, 1), prod_date=D(2020, 1, 1), price=Decimal("2.50")) for i in range(3)])
    sold = frame(spark, [], "prescription_id int, drug_id int, quantity bigint, total_price decimal(10,2)")
    alerts = pharmacy.low_stock(drugs.limit(0), moment("2024-01-01 00:00:00"))
    stock = VersionedTable(drugs, f"{tmp_path}/stock")
    sales = AppendedTable(sold, f"{tmp_path}/sold")
    waiting = frame(spark, [], "request_id int, request_ts timestamp_ntz, prescription_id int, drug_name string, req_qty int")
    invoices = AppendedTable(table(spark, "invoice", []), f"{tmp_path}/invoices")
    details = AppendedTable(table(spark, "invoice_details", []).drop("invoice_details_id"), f"{tmp_path}/details")
    outcomes = AppendedTable(frame(spark, [], "request_id int, accepted boolean, message string, total decimal(19,2)"), f"{tmp_path}/outcomes")

    def serve(arriving):
        return operations.sell_from_stream(
            arriving, frame(spark, [(i, i) for i in range(30)], "prescription_id int, p_id int"), stock, sales,
            VersionedTable(alerts, f"{tmp_path}/alerts"), VersionedTable(waiting, f"{tmp_path}/waiting"), invoices, details, outcomes,
            moment("2024-01-10 00:00:00"), f"{tmp_path}/state",
        )

    last = serve(stream)
    assert last == 2
    asked = {}
    for p in parts:
        for *_, name, qty in p:
            asked[name] = asked.get(name, 0) + qty
    left = dict(rows(stock.after(spark, last), "drug_id", "quantity"))
    assert left == {i: max(0, 20 + i - asked.get(f"drug {i}", 0)) for i in range(3)}
    taken = sales.after(spark, last).groupBy("drug_id").agg(F.sum("quantity").alias("n"))
    assert {r.drug_id: r.n for r in taken.collect()} == {i: 20 + i - left[i] for i in left}
    answered = outcomes.after(spark, last)
    assert answered.count() == 24 and answered.filter("accepted").count() == 24
    made = invoices.after(spark, last)
    assert made.select("invoice_id").distinct().count() == made.count()
    assert details.after(spark, last).agg(F.sum("quantity")).first()[0] == sum(20 + i - left[i] for i in left)
    # Nothing new arrives: the last version is still found.
    assert serve(stream) == last and dict(rows(stock.after(spark, last), "drug_id", "quantity")) == left
    # A batch that is run again starts from its predecessor's table.
    assert dict(rows(stock.before(spark, 0), "drug_id", "quantity")) == {0: 20, 1: 21, 2: 22}


def test_booking_cap_holds_across_batches(spark, tmp_path):
    parts = [[(b * 100 + i, TS(2024, 1, 10, 8 + b, i), 1 + i % 2) for i in range(15)] for b in range(3)]
    parts.append([(900, TS(2024, 1, 14, 8), 1), (901, TS(2024, 1, 10, 9), 2)])
    parts.append([(902, TS(2024, 1, 10, 9), 2)])
    stream = files(spark, tmp_path, parts, "request_id int, request_ts timestamp_ntz, doctor_id int")
    counts = VersionedTable(frame(spark, [], "doctor_id int, day date, booked bigint"), f"{tmp_path}/counts")
    last = operations.book_from_stream(stream, counts, f"{tmp_path}/ok", f"{tmp_path}/state", cap=20)
    answers = spark.read.parquet(f"{tmp_path}/ok").collect()
    ok = [r.request_id for r in answers if r.accepted]
    assert sorted(r.request_id for r in answers) == sorted(rid for p in parts for rid, _, _ in p)
    assert {r.request_id: r.message for r in answers if r.late} == {902: operations.TOO_LATE}
    assert all((r.message == operations.FULL) == (not r.accepted) for r in answers if not r.late)
    first = {1: [], 2: []}
    for p in parts[:3]:
        for rid, _, doc in p:
            if len(first[doc]) < 20:
                first[doc].append(rid)
    # 901 finds the day full, 902 asks for a day that is settled.
    assert len(first[1]) == len(first[2]) == 20
    assert sorted(ok) == sorted(first[1] + first[2] + [900])
    assert rows(counts.after(spark, last), "doctor_id", "day") == [(1, D(2024, 1, 14))]


def test_reports_follow_new_files(spark, tmp_path):
    people = frame(spark, [(1, 1), (2, 2), (3, 1)], "emp_id int, dept_id int")
    departments = table(spark, "department", [dict(dept_id=1, dept_name="A"), dict(dept_id=2, dept_name="B")])
    parts = [[(1, Decimal("1.50")), (2, Decimal("2.00"))], [(3, Decimal("4.00")), (9, Decimal("8.00"))]]
    stream = files(spark, tmp_path, parts, "emp_id int, paid_money decimal(12,2)")
    totals = VersionedTable(frame(spark, [], "dept_name string, total_revenue decimal(28,2)"), f"{tmp_path}/totals")
    last = operations.refresh_revenue(stream, people, departments, totals, f"{tmp_path}/state")
    assert rows(totals.after(spark, last)) == [("A", Decimal("5.50")), ("B", Decimal("2.00"))]
    # A later run without new files still finds the report.
    again = operations.refresh_revenue(stream, people, departments, totals, f"{tmp_path}/state")
    assert again == last and rows(totals.after(spark, again)) == [("A", Decimal("5.50")), ("B", Decimal("2.00"))]


def test_patient_months_count_each_patient_once(spark, tmp_path):
    parts = [[(1, TS(2024, 1, 1)), (2, TS(2024, 1, 2))], [(1, TS(2024, 1, 9)), (1, TS(2024, 2, 1))]]
    stream = files(spark, tmp_path, parts, "p_id int, date_time timestamp_ntz")
    pairs = AppendedTable(frame(spark, [], "month string, p_id int, first_seen timestamp_ntz"), f"{tmp_path}/pairs")
    last = operations.refresh_patient_months(stream, pairs, f"{tmp_path}/state")
    assert rows(pairs.after(spark, last)) == [
        ("2024-01", 1, TS(2024, 1, 1)), ("2024-01", 2, TS(2024, 1, 2)), ("2024-02", 1, TS(2024, 2, 1))
    ]


def test_late_rows_are_kept_beside_the_stream(spark, tmp_path):
    """Several deliveries: what the stream leaves out is in the late rows, and together no day is missing."""
    rng = random.Random(6)
    ddl = "request_id int, emp_id int, ts timestamp"
    parts = [[(b * 100 + i, rng.choice([1, 1, 1, 2, 3]), TS(2024, 1, rng.randrange(1, 10 + 6 * b), 8, i)) for i in range(40)] for b in range(3)]
    late, found = [], []
    for b, part in enumerate(parts):
        frame(spark, part, ddl).write.parquet(f"{tmp_path}/in/p{b}")
        stream = spark.readStream.schema(frame(spark, part, ddl).schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        late = attendance.late_rows(stream, "2 days")
        found = attendance.first_check_ins(stream, "2 days").select("emp_id", "attend_date", "ts")
        to_folder(late, f"{tmp_path}/late", f"{tmp_path}/late_state")
        to_folder(found, f"{tmp_path}/found", f"{tmp_path}/found_state")
    late = spark.read.schema(late.schema).parquet(f"{tmp_path}/late")
    found = spark.read.schema(found.schema).parquet(f"{tmp_path}/found")
    mark, want = None, set()
    for part in parts:
        if mark:
            want |= {r[0] for r in part if (mark - r[2]).total_seconds() >= 2 * 86400}
        mark = max([r[2] for r in part] + ([mark] if mark else []))
    assert want and {r["request_id"] for r in late.collect()} == want
    whole = rows(attendance.with_late_check_ins(found, late), "emp_id", "attend_date")
    assert whole == sorted({(e, ts.date()) for p in parts for _, e, ts in p})
