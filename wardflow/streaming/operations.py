"""Stock, bookings and reports kept up to date per micro-batch."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.operators.guards import REQUEST_ORDER
from wardflow.operators.snapshots import append
from wardflow.plans.pharmacy import DEFERRED, prescription_sale
from wardflow.session import materialize
from wardflow.streaming.state import AppendedTable, VersionedTable, each_batch


def sell_from_stream(
    lines: DataFrame,
    prescriptions: DataFrame,
    stock: VersionedTable,
    sold: AppendedTable,
    alerts: VersionedTable,
    waiting: VersionedTable,
    invoice: AppendedTable,
    invoice_details: AppendedTable,
    outcomes: AppendedTable,
    as_of: Column,
    checkpoint: str,
) -> int:
    """Serve prescription lines as they arrive; stock, alerts and requests that wait carry over.

    ``lines``: request_id, request_ts, prescription_id, drug_name, req_qty. All lines
    of a request must arrive in one batch. A request that has to wait (the first one for
    its prescription sold nothing) is served again with the next batch; until then its
    lines stand in ``waiting``. Sales, invoices, their lines and the answers are appended.
    """

    def sell(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        # The batch is written down once; it feeds several plans.
        queued = waiting.before(spark, batch_id)
        batch = materialize(arrived.select(*queued.columns).unionByName(queued), "sales")
        requests = (
            batch.select(*REQUEST_ORDER, "prescription_id")
            .distinct()
            .withColumns({"payment_method": F.lit(None).cast("string"), "emp_id": F.lit(None).cast("int")})
        )
        result = prescription_sale(
            requests,
            batch.select("request_id", "drug_name", "req_qty"),
            prescriptions,
            sold.before(spark, batch_id),
            stock.before(spark, batch_id),
            alerts.before(spark, batch_id),
            invoice.before(spark, batch_id),
            as_of,
        )
        outcomes.write(batch_id, result.outcomes)
        deferred = outcomes.of(spark, batch_id).filter(F.col("message") == DEFERRED).select("request_id")
        written = {
            stock: result.tables["pharmacy_drugs"],
            alerts: result.tables["low_stock_alerts"],
            sold: result.tables["prescription_drugs"],
            invoice: result.tables["invoice"],
            invoice_details: result.tables["invoice_details"],
            waiting: batch.join(deferred, "request_id", "left_semi").select(*queued.columns),
        }
        # The tables do not depend on each other.
        with ThreadPoolExecutor(len(written)) as pool:
            list(pool.map(lambda table, rows: table.write(batch_id, rows), written, written.values()))

    return each_batch(lines, sell, checkpoint)


FULL = "Maximum daily reservations reached for this doctor."
TOO_LATE = "The day asked for is settled."


def book_from_stream(
    requests: DataFrame, counts: VersionedTable, outcomes_folder: str, checkpoint: str, cap: int = 20, keep_days: int = 1
) -> int:
    """Accept bookings up to ``cap`` per doctor and day across batches.

    ``requests``: request_id, request_ts, doctor_id. Every request is answered in
    ``outcomes_folder``: accepted, message (NULL when accepted) and late. The count of a
    day is dropped once the newest request is more than ``keep_days`` later; a request
    for a dropped day is refused as late, for a batch job over the whole history to take up.
    """

    def book(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        before = counts.before(spark, batch_id)
        horizon = before.agg(F.coalesce(F.max("day"), F.lit("1900-01-01").cast("date"))).scalar()
        daily = arrived.withColumn("day", F.to_date("request_ts"))
        daily = materialize(daily.withColumn("late", F.col("day") < F.date_sub(horizon, keep_days)), "bookings")
        # The row limit goes ahead of the shuffle: a crowded day sends few rows per task.
        line = Window.partitionBy("doctor_id", "day").orderBy(*REQUEST_ORDER)
        first = daily.filter("not late").withColumn("place", F.row_number().over(line)).filter(F.col("place") <= cap)
        known = before.select("doctor_id", "day", "booked")
        won = (
            first.join(known, ["doctor_id", "day"], "left")
            .filter(F.col("place") <= cap - F.coalesce("booked", F.lit(0)))
            .select("request_id", F.lit(True).alias("_won"))
        )
        answered = daily.join(won, "request_id", "left").select(
            "request_id",
            "request_ts",
            "doctor_id",
            "day",
            F.coalesce("_won", F.lit(False)).alias("accepted"),
            F.when(F.col("late"), TOO_LATE).when(F.col("_won").isNull(), FULL).alias("message"),
            "late",
        )
        target = f"{outcomes_folder}/batch={batch_id}"
        answered.write.mode("overwrite").parquet(target)
        accepted = spark.read.schema(answered.schema).parquet(target).filter("accepted")
        added = accepted.groupBy("doctor_id", "day").agg(F.count("*").alias("more"))
        merged = known.join(added, ["doctor_id", "day"], "full_outer").select(
            "doctor_id", "day", (F.coalesce("booked", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("booked")
        )
        newest = F.greatest(horizon, accepted.agg(F.max("day")).scalar())
        counts.write(batch_id, merged.filter(F.col("day") >= F.date_sub(newest, keep_days)))

    return each_batch(requests, book, checkpoint)


def refresh_revenue(
    invoices: DataFrame, employee: DataFrame, department: DataFrame, totals: VersionedTable, checkpoint: str
) -> int:
    """Revenue by department, brought up to date with the invoices that are new.

    ``totals``: dept_name, total_revenue.
    """
    names = employee.select("emp_id", "dept_id").join(department.select("dept_id", "dept_name"), "dept_id")

    def add(batch: DataFrame, batch_id: int) -> None:
        before = totals.before(batch.sparkSession, batch_id)
        per_issuer = batch.groupBy("emp_id").agg(F.sum("paid_money").alias("paid"))
        fresh = per_issuer.join(names, "emp_id").groupBy("dept_name").agg(F.sum("paid").alias("paid"))
        old = before.select("dept_name", F.col("total_revenue").alias("paid"))
        both = old.unionByName(fresh.select("dept_name", F.col("paid").cast(old.schema["paid"].dataType)))
        merged = both.groupBy("dept_name").agg(F.sum("paid").alias("total_revenue"))
        totals.write(batch_id, append(before.filter(F.lit(False)), merged))

    return each_batch(invoices, add, checkpoint)


def refresh_patient_months(reservations: DataFrame, pairs: AppendedTable, checkpoint: str) -> int:
    """Distinct (month, patient) pairs seen so far; counting them gives the monthly report.

    A batch appends the pairs that are new; what is known is read, not written again.

    ``reservations``: p_id, date_time; ``pairs``: month, p_id, first_seen.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        before = pairs.before(batch.sparkSession, batch_id)
        seen = batch.groupBy(F.date_format("date_time", "yyyy-MM").alias("month"), "p_id").agg(
            F.min("date_time").cast("timestamp_ntz").alias("first_seen")
        )
        pairs.write(batch_id, seen.join(before.select("month", "p_id"), ["month", "p_id"], "left_anti"))

    return each_batch(reservations, add, checkpoint)
