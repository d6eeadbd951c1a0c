"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wardflow.catalog import index
from wardflow.session import bench_cpus, build_session, clear_scratch

HEADLINE = (
    "monthly_salary",
    "revenue_by_department",
    "top_doctors",
    "monthly_new_patients",
    "reservations_full",
    "invoices_full",
    "expiry_alert",
    "attendance_checkin",
    "attendance_deduction",
    "missing_checkout",
    "raise_by_employee",
    "repeat_schedule",
    "book_doctor",
    "book_lab",
    "book_radiology",
    "post_results",
    "prescription_sale",
    "reserve_room",
    "room_checkout",
    "surgery_conflicts",
    "surgery_schedule_auto",
    "cancel_surgery_invoices",
    "dq_invoice_balance",
    "dq_duplicate_keys",
    "numbered_reservations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    cpus = bench_cpus()
    spark = build_session(
        "wardflow-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = index.queries()
    # One small query first, so that starting the engine is not counted.
    registered["revenue_by_department"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
