"""Prescription sales, stock alerts, restocking and new drugs."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.clock import day_first_text
from wardflow.functions.money import money
from wardflow.functions.text import folded, joined, normalised_name
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, first_per, flagged, turn
from wardflow.operators.scan import block_of, in_order, running, with_next_ids
from wardflow.operators.snapshots import append, upsert
from wardflow.operators.text import report_lines
from wardflow.session import materialize

LOW_STOCK = 10
PHARMACY_DEPARTMENT = 12
RESTOCK_QUANTITY = 50
DEFERRED = "Deferred to the next batch."


def drug_lookup(drugs: DataFrame) -> DataFrame:
    """One drug per normalised name: the lowest id."""
    return drugs.groupBy(normalised_name("drug_name").alias("_name")).agg(
        F.min(F.struct("drug_id", "price", "quantity")).alias("_drug")
    )


def prescription_sale(
    requests: DataFrame,
    lines: DataFrame,
    prescriptions: DataFrame,
    sold: DataFrame,
    drugs: DataFrame,
    alerts: DataFrame,
    invoice: DataFrame,
    as_of: Column,
) -> JobResult:
    """Sell the drugs of prescriptions from stock, in request order.

    ``requests``: request_id, request_ts, prescription_id, payment_method, emp_id;
    ``lines``: request_id, drug_name, req_qty. Served greedily: with R the running
    quantity asked for a drug and S its stock, a line gets least(S, R) minus
    least(S, R before it). A line of which nothing is left is skipped; a prescription
    counts as processed once it sold something. Later requests for a prescription of
    the same batch are answered after the first. The message holds the stock line of
    every drug asked for; the ``stock_report`` table has them as rows.
    """
    lookup = drug_lookup(drugs).select("_name", "_drug.drug_id", "_drug.price", F.col("_drug.quantity").cast("long").alias("stock"))
    # Every way a drug is written in the batch, numbered per drug; lines carry numbers instead of names.
    written = lines.select("drug_name").distinct().withColumn("_name", normalised_name("drug_name")).filter("_name is not null")
    spelled = written.withColumn("_spelling", F.row_number().over(Window.partitionBy("_name").orderBy("drug_name")))
    spelled = materialize(spelled.join(lookup, "_name", "left").drop("_name"), "spelled")
    known = prescriptions.select("prescription_id", F.col("p_id"))
    done = sold.select("prescription_id").distinct()
    # One row per request and drug, so that a drug listed twice is taken as one line, after lines have been
    # brought together by request. Unknown drugs count as one without id.
    named = (
        lines.join(spelled.select("drug_name", "drug_id", "_spelling"), "drug_name", "left")
        .select("request_id", "drug_id", "_spelling", "req_qty")
        .repartition("request_id")
        .groupBy("request_id", "drug_id")
        .agg(F.sum("req_qty").cast("long").alias("req_qty"), F.min("_spelling").alias("_spelling"))
    )
    named = materialize(named, "named")
    unmatched = named.filter("drug_id is null").select("request_id").distinct()
    asked = flagged(requests.join(known.withColumn("known", F.lit(True)), "prescription_id", "left"), done, ["prescription_id"], "processed")
    asked = flagged(asked, unmatched, ["request_id"], "unmatched").withColumn(
        "refused",
        first_failure(
            [
                (F.col("known").isNull(), "Prescription not found."),
                (F.col("processed"), "This prescription has already been processed."),
                (F.col("unmatched"), "One or more drugs not found in inventory."),
            ]
        ),
    )
    asked = materialize(asked, "asked")
    firsts = first_per(asked.filter("refused is null"), ["prescription_id"], "payment_method", "p_id", "emp_id")
    firsts = in_order(firsts, REQUEST_ORDER, "_at", "firsts")
    serving = firsts.select("request_id", "prescription_id")

    wanted = named.join(firsts.select("request_id", "prescription_id", "_at"), "request_id")
    wanted = materialize(wanted.withColumn("_block", block_of("_at")), "wanted")
    # The lines of a request stay together in its block of the order.
    in_line = running(wanted, ["drug_id"], ["_at"], {"asked_so_far": ("sum", F.col("req_qty"))}, block="_block").join(
        spelled, ["drug_id", "_spelling"]
    )
    left = in_line.withColumn(
        "sold_qty",
        F.least("stock", "asked_so_far") - F.least(F.col("stock"), F.col("asked_so_far") - F.col("req_qty")),
    ).withColumns(
        {
            "total_price": F.when(F.col("sold_qty") > 0, money(F.col("price") * F.col("sold_qty"), 19, 4)),
            "left": F.col("stock") - F.least("stock", "asked_so_far"),
        }
    )
    stock_line = joined(F.lit("• "), "drug_name", F.lit(": "), "left")
    # Every request that is served, with its total, its report and what it was sold, grouped once.
    along = {
        "total": F.sum("total_price"),
        "given": F.collect_list(F.when(F.col("sold_qty") > 0, F.struct("drug_id", "price", "sold_qty", "total_price"))),
    }
    reports = report_lines(left, ["request_id", "_block", "prescription_id"], stock_line, ["drug_name", "drug_id"], "stock_text", few=along)
    served = materialize(reports.drop("_block"), "served")

    def lines_sold(of: DataFrame, *carry: str) -> DataFrame:
        return of.select(*carry, "prescription_id", F.explode("given").alias("_line")).select(*carry, "prescription_id", "_line.*")

    sales = lines_sold(served)
    taken = sales.groupBy("drug_id").agg(F.sum("sold_qty").alias("taken"))
    stock = drugs.join(taken, "drug_id", "left").withColumn(
        "quantity", (F.col("quantity") - F.coalesce("taken", F.lit(0))).cast(drugs.schema["quantity"].dataType)
    ).select(*drugs.columns)
    next_alerts = stock_alerts(alerts, stock, wanted.select("drug_id").distinct(), as_of)

    billed = firsts.drop("_at").join(served.filter("total > 0").select("request_id", "total"), "request_id")
    headers = cache(lambda: with_next_ids(billed, invoice, "invoice_id", REQUEST_ORDER))
    # The first request of a prescription is served; if it sold anything, later ones are too late.
    later = asked.join(serving.select("request_id", "prescription_id"), ["request_id", "prescription_id"], "left_anti").join(
        serving.select("prescription_id", F.col("request_id").alias("served_by")), "prescription_id", "left"
    )
    sold_any = served.select(F.col("request_id").alias("served_by"), F.col("total").alias("first_total"))
    cr = F.chr(F.lit(13))
    first_total = F.coalesce("total", F.lit(0).cast("decimal(19,4)"))
    sale = F.concat(
        F.lit("Sale completed successfully."),
        cr,
        F.lit("Total Invoice Amount: "),
        money(first_total, 19, 2).cast("string"),
        cr,
        F.lit("Remaining Stock:"),
        cr,
        F.coalesce("stock_text", F.lit("")),
    )
    # A request without lines is served, too.
    empty = serving.select("request_id").join(served, "request_id", "left_anti")
    answered = served.select("request_id", "total", "stock_text").unionByName(empty, allowMissingColumns=True).select(
        "request_id", F.lit(True).alias("accepted"), sale.alias("message"), money(first_total, 19, 2).alias("total")
    )
    refused = later.join(sold_any, "served_by", "left").select(
        "request_id",
        F.lit(False).alias("accepted"),
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("first_total") > 0, F.lit("This prescription has already been processed."))
        .otherwise(DEFERRED)
        .alias("message"),
        F.lit(None).cast("decimal(19,2)").alias("total"),
    )
    outcomes = answered.unionByName(refused)

    def details() -> DataFrame:
        invoiced = served.filter("total > 0").join(headers().select("request_id", "invoice_id"), "request_id")
        return lines_sold(invoiced, "invoice_id").select(
            "invoice_id",
            F.col("prescription_id").alias("reservation_id"),
            F.lit("Pharmacy").alias("reservation_type"),
            F.col("drug_id").alias("process_id"),
            F.col("price").alias("unit_price"),
            F.col("sold_qty").alias("quantity"),
            money("total_price", 12).alias("total"),
            F.lit(PHARMACY_DEPARTMENT).alias("dept_id"),
        )

    return JobResult(
        outcomes,
        {
            "prescription_drugs": sales.select(
                "prescription_id", "drug_id", F.col("sold_qty").alias("quantity"), money("total_price").alias("total_price")
            ),
            "pharmacy_drugs": stock,
            "low_stock_alerts": next_alerts,
            "stock_report": left.select("request_id", "drug_id", stock_line.alias("line")),
            "invoice": lambda: headers().select(
                "invoice_id",
                as_of.cast("date").alias("date"),
                "payment_method",
                money("total").alias("paid_money"),
                "p_id",
                "emp_id",
            ),
            "invoice_details": details,
        },
    )


def stock_alerts(
    alerts: DataFrame, stock: DataFrame, touched: DataFrame, as_of: Column, threshold: int = LOW_STOCK
) -> DataFrame:
    """Alert table after a sale: touched drugs get their current quantity, and leave
    the table when they are no longer low."""
    current = stock.join(touched, "drug_id", "left_semi").select(
        "drug_id", "drug_name", F.col("quantity").alias("current_qty"), as_of.alias("alert_date")
    )
    merged = upsert(alerts, current, ["drug_id"], keep=["drug_name"])
    plenty = current.filter(F.col("current_qty") >= threshold).select("drug_id")
    return merged.join(plenty, "drug_id", "left_anti")


def low_stock(drugs: DataFrame, as_of: Column, threshold: int = LOW_STOCK) -> DataFrame:
    """Drugs below the threshold, in the shape of the alert table."""
    return drugs.filter(F.col("quantity") < threshold).select(
        "drug_id", "drug_name", F.col("quantity").alias("current_qty"), as_of.alias("alert_date")
    )


def restock_low(
    alerts: DataFrame, drugs: DataFrame, as_of: Column, quantity: int = RESTOCK_QUANTITY, ratio: str = "0.7"
) -> JobResult:
    """Buy a fixed quantity for every alert, add it to stock and clear the alerts."""
    cost = F.round(F.col("price").cast("decimal(19,4)") * F.lit(ratio).cast("decimal(3,1)"), 2).cast("decimal(19,4)")
    priced = alerts.select("drug_id", "drug_name").join(drugs.select("drug_id", "price"), "drug_id")
    purchases = priced.select(
        "drug_id",
        "drug_name",
        F.lit(quantity).alias("quantity"),
        money(cost).alias("unit_cost"),
        as_of.cast("date").alias("purchase_date"),
        money(cost * quantity, 19, 2).alias("total"),
    )
    bought = alerts.select("drug_id").distinct().withColumn("_bought", F.lit(True))
    kind = drugs.schema["quantity"].dataType
    stocked = drugs.join(bought, "drug_id", "left").withColumn(
        "quantity", (F.col("quantity") + F.when(F.col("_bought"), quantity).otherwise(0)).cast(kind)
    )
    report = purchases.select(
        "drug_id",
        joined(
            F.lit("• "),
            "drug_name",
            F.lit(" | Purchased: "),
            "quantity",
            F.lit(" | Unit Cost: "),
            "unit_cost",
            F.lit(" | Total: "),
            "total",
        ).alias("line"),
    )
    # One line for each purchase, in the order of the drugs.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("drug_id", "line"))), lambda x: x["line"]), "\r")
    heading = F.lit("Purchase completed successfully:\r\r")
    outcome = report.agg(F.count("*").alias("purchases"), whole.alias("_lines")).select(
        "purchases",
        F.when(F.col("purchases") == 0, "No low-stock drugs found. Nothing to purchase.")
        .otherwise(F.concat(heading, F.col("_lines"), F.lit("\r")))
        .alias("message"),
    )
    return JobResult(
        outcome,
        {
            "drug_purchases": purchases,
            "pharmacy_drugs": stocked.select(*drugs.columns),
            "low_stock_alerts": alerts.filter(F.lit(False)),
            "report": report,
        },
    )


def add_drugs(requests: DataFrame, drugs: DataFrame, as_of: Column, markup: str = "1.3") -> JobResult:
    """New drugs: a name in stock (case ignored, blanks not) is refused.

    Accepted requests are bought at cost and sold at cost plus 30 %.
    """
    names = drugs.select(F.lower("drug_name").alias("_name")).distinct()
    asked = flagged(requests.withColumn("_name", F.lower("drug_name")), names, ["_name"], "in_stock")
    firsts = first_per(asked.filter("not in_stock"), ["_name"]).select("request_id")
    new = with_next_ids(asked.join(firsts, "request_id", "left_semi"), drugs, "drug_id", REQUEST_ORDER)
    cost = money("unit_cost", 19, 4)
    price = (cost * F.lit(markup).cast("decimal(2,1)")).cast("decimal(19,4)")
    cr = F.chr(F.lit(13))
    added_text = F.concat(
        F.lit('✅ Drug "'),
        F.col("drug_name"),
        F.lit('" added successfully.'),
        cr,
        F.lit("Quantity: "),
        F.col("quantity").cast("string"),
        cr,
        F.lit("Purchase Price: "),
        money("unit_cost", 19).cast("string"),
        cr,
        F.lit("Selling Price (approx): "),
        (money("unit_cost", 19, 4) * F.lit(markup).cast("decimal(2,1)")).cast("decimal(19,5)").cast("string"),
        cr,
        F.lit("Purchase Date: "),
        day_first_text(as_of),
    )
    outcomes = asked.join(new.select("request_id", "drug_id"), "request_id", "left").select(
        "request_id",
        F.col("drug_id").isNotNull().alias("accepted"),
        F.when(F.col("drug_id").isNotNull(), added_text)
        .otherwise(F.concat(F.lit('⚠ The drug "'), F.col("drug_name"), F.lit('" already exists in the pharmacy.')))
        .alias("message"),
        "drug_id",
    )
    purchases = new.select(
        "drug_name",
        "quantity",
        money(cost).alias("unit_cost"),
        as_of.cast("date").alias("purchase_date"),
        money(cost * F.col("quantity"), 19, 2).alias("total"),
    )
    stocked = new.withColumn("price", money(price))
    return JobResult(outcomes, {"drug_purchases": purchases, "pharmacy_drugs": append(drugs, stocked)})
