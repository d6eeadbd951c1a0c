"""Shifts, shift assignment, schedule roll-over, departments and employees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.money import money
from wardflow.functions.text import folded, same_text
from wardflow.operators.catalogue import Messages, catalogue_changes
from wardflow.operators.guards import REQUEST_ORDER, JobResult, first_failure, first_per, turn
from wardflow.operators.replay import Answer, Book, Rules, replay
from wardflow.operators.scan import running, with_next_ids
from wardflow.operators.snapshots import append, delete_keys
from wardflow.operators.unique import accept_in_order

SHIFT_TEXTS = Messages(
    inserted="Shift added successfully",
    name_exists="Shift name already exists",
    updated="Shift updated successfully",
    name_taken="Shift name already exists for another shift",
    deleted="Shift deleted successfully",
    missing="Shift not found",
    missing_first=True,
    in_use="Cannot delete shift assigned to employees",
)


def shift_changes(changes: DataFrame, shift: DataFrame, emp_shift: DataFrame) -> JobResult:
    """Add, rename and delete shifts; a shift with employees stays."""
    return catalogue_changes(
        changes, shift, "shift_id", "shift_name", ["shift_name"], SHIFT_TEXTS, used=emp_shift, table="shift"
    )


def repeat_schedule(dated: DataFrame) -> DataFrame:
    """Schedule with the latest month copied to the month after it.

    Days the next month does not have are dropped. If the next month is longer, one
    more day is filled from the last but one day of the old month.
    """
    latest = dated.agg(F.trunc(F.max("date"), "MM")).scalar()
    first = F.add_months(latest, 1)
    old_days, new_days = F.day(F.last_day(latest)), F.day(F.last_day(first))
    day = F.day("date")
    same_day = F.when(day <= new_days, F.date_add(first, day - 1))
    extra_day = F.when((new_days > old_days) & (day == old_days - 1), F.date_add(first, old_days))
    copies = (
        dated.filter(F.col("date") >= latest)
        .withColumn("date", F.explode(F.array_compact(F.array(same_day, extra_day))))
        .select(*dated.columns)
    )
    kept = dated.filter(F.trunc("date", "MM") != first)
    return kept.unionByName(copies)


def repeat_schedule_outcome(dated: DataFrame) -> DataFrame:
    """What the roll-over of a schedule answers."""
    return dated.agg(F.max("date").alias("_latest")).select(
        F.col("_latest").isNotNull().alias("accepted"),
        F.when(F.col("_latest").isNull(), "No previous shifts found to copy.")
        .otherwise("Shift appointments have been repeated successfully for the next month.")
        .alias("message"),
    )


def _people(employee: DataFrame) -> DataFrame:
    return employee.select(
        "emp_id", F.lit(True).alias("known"), same_text("status", "inactive").alias("inactive")
    )


def _shift_ids(shift: DataFrame) -> DataFrame:
    return shift.select("shift_id").withColumn("shift_known", F.lit(True))


INACTIVE_SHIFT = "This employee is inactive and cannot be assigned to a shift"


def assign_shift(requests: DataFrame, employee: DataFrame, shift: DataFrame, emp_shift: DataFrame) -> JobResult:
    """One shift per employee; the refusal names the lowest shift already held."""
    held = emp_shift.groupBy("emp_id").agg(F.min("shift_id").alias("held"))
    asked = (
        requests.join(_people(employee), "emp_id", "left")
        .join(_shift_ids(shift), "shift_id", "left")
        .join(held, "emp_id", "left")
        .withColumn(
            "refused",
            first_failure(
                [
                    (F.col("known").isNull(), "This employee does not exist"),
                    (F.col("inactive"), INACTIVE_SHIFT),
                    (F.col("shift_known").isNull(), "This shift does not exist"),
                ]
            ),
        )
    )
    winners = first_per(asked.filter("refused is null and held is null"), ["emp_id"], "shift_id")
    given = winners.select("emp_id", F.struct(*REQUEST_ORDER).alias("_first"), F.col("shift_id").alias("_given"))
    held_by = F.coalesce("held", "_given").cast("string")
    busy = F.concat(
        F.lit("This employee is already assigned to shift number "),
        held_by,
        F.lit(" and cannot be assigned to another shift."),
    )
    won = F.col("refused").isNull() & F.coalesce(F.col("_first") == turn(), F.lit(False))
    outcomes = asked.join(given, "emp_id", "left").select(
        "request_id",
        won.alias("accepted"),
        F.when(won, "✅ Employee assigned to shift successfully").otherwise(F.coalesce("refused", busy)).alias("message"),
    )
    return JobResult(outcomes, {"emp_shift": append(emp_shift, winners)})


def move_shift(requests: DataFrame, employee: DataFrame, shift: DataFrame, emp_shift: DataFrame) -> JobResult:
    """Replace an employee's shift.

    A move to the shift held at that moment is refused. Whoever has no shift gets a
    success message but still has none.
    """
    held = emp_shift.groupBy("emp_id").agg(F.collect_set("shift_id").alias("held"))
    asked = (
        requests.join(_people(employee), "emp_id", "left")
        .join(_shift_ids(shift), "shift_id", "left")
        .join(held, "emp_id", "left")
        .withColumn(
            "refused",
            first_failure(
                [
                    (F.col("known").isNull(), "This employee does not exist"),
                    (F.col("inactive"), INACTIVE_SHIFT),
                    (F.col("shift_known").isNull(), "The new shift does not exist"),
                ]
            ),
        )
    )
    valid = asked.filter("refused is null")
    # The shift in force before a request is the one the previous valid request asked for.
    line = running(
        valid.filter("held is not null").select("emp_id", "shift_id", "held", *REQUEST_ORDER),
        ["emp_id"],
        list(REQUEST_ORDER),
        {"before": ("max", F.struct(*REQUEST_ORDER, "shift_id"))},
        inclusive=False,
    )
    repeated = line.filter(
        F.when(F.col("before").isNotNull(), F.col("before.shift_id") == F.col("shift_id")).otherwise(
            F.array_contains("held", F.col("shift_id"))
        )
    ).select("request_id")
    outcomes = (
        asked.join(repeated.withColumn("_same", F.lit(True)), "request_id", "left")
        .withColumn(
            "refused", F.coalesce("refused", F.when(F.col("_same"), "This employee already exists in this shift"))
        )
        .select(
            "request_id",
            F.col("refused").isNull().alias("accepted"),
            F.coalesce("refused", F.lit("Shift has been modified successfully")).alias("message"),
        )
    )
    final = valid.groupBy("emp_id").agg(F.max_by("shift_id", turn()).alias("shift_id"))
    moved = emp_shift.select("emp_id").distinct().join(final, "emp_id")
    next_state = append(delete_keys(emp_shift, moved, ["emp_id"]), moved)
    return JobResult(outcomes, {"emp_shift": next_state})


def unassign_shift(requests: DataFrame, emp_shift: DataFrame) -> JobResult:
    """Remove exact (employee, shift) pairs; a pair can be removed once."""
    pair = ["emp_id", "shift_id"]
    asked = requests.join(emp_shift.select(*pair).withColumn("_known", F.lit(True)), pair, "left")
    gone = first_per(asked.filter("_known"), pair)
    won = F.coalesce(F.col("_first") == turn(), F.lit(False))
    outcomes = asked.join(gone.select(*pair, F.struct(*REQUEST_ORDER).alias("_first")), pair, "left").select(
        "request_id",
        won.alias("accepted"),
        F.when(won, "Employee has been deleted from the shift successfully")
        .otherwise("Emp_id and shift_id mismatched")
        .alias("message"),
    )
    return JobResult(outcomes, {"emp_shift": delete_keys(emp_shift, gone, pair)})


MANAGER_BUSY = "This manager is already assigned to another department"
NO_MANAGER = "Manager ID not found in Employee table"
INACTIVE_MANAGER = "This manager is inactive can not be a manager"
STAFFED = "Cannot delete department with assigned employees"


def _managers(employee: DataFrame) -> DataFrame:
    return employee.select(
        F.col("emp_id").alias("manager_id"), F.lit(True).alias("known"), same_text("status", "active").alias("active")
    )


def _manager_rules(compat: bool) -> list[tuple[Column, str]]:
    """A missing manager counts as inactive in the compatible form only."""
    given = F.col("manager_id").isNotNull()
    inactive = ~F.coalesce("active", F.lit(False))
    return [
        (given & F.col("known").isNull(), NO_MANAGER),
        (inactive if compat else given & inactive, INACTIVE_MANAGER),
        (given & F.col("manages").isNotNull(), MANAGER_BUSY),
    ]


def add_departments(requests: DataFrame, department: DataFrame, employee: DataFrame, compat: bool = True) -> JobResult:
    """New departments: unique name, manager exists, is active and manages nothing yet."""
    names = department.select(folded("dept_name").alias("_name")).distinct().withColumn("_taken", F.lit(True))
    manages = department.filter("manager_id is not null").select("manager_id").distinct().withColumn("manages", F.lit(True))
    exists = "This department name already exists"
    asked = (
        requests.withColumn("_name", folded("dept_name"))
        .join(names, "_name", "left")
        .join(_managers(employee), "manager_id", "left")
        .join(manages, "manager_id", "left")
        .withColumn("refused", first_failure([(F.col("_taken"), exists), *_manager_rules(compat)]))
    )
    winners = accept_in_order(asked.filter("refused is null"), ["_name", "manager_id"])
    rows = with_next_ids(
        asked.join(winners.select("request_id"), "request_id", "left_semi"), department, "dept_id", REQUEST_ORDER
    )
    by_name = winners.select("_name", turn().alias("_name_turn"))
    outcomes = (
        asked.join(rows.select("request_id", "dept_id"), "request_id", "left")
        .join(by_name, "_name", "left")
        .select(
            "request_id",
            F.col("dept_id").isNotNull().alias("accepted"),
            F.when(F.col("dept_id").isNotNull(), "Department added successfully")
            # The name test comes first, also against departments added earlier in the batch.
            .when(F.col("_name_turn") < turn(), exists)
            .otherwise(F.coalesce("refused", F.lit(MANAGER_BUSY)))
            .alias("message"),
            "dept_id",
        )
    )
    return JobResult(outcomes, {"department": append(department, rows)})


NAME_USED = "This department name is already used by another department"
NAME_EXISTS = "This department name already exists"
NO_SUCH_DEPARTMENT = "Department not found"


def _department_rules(compat: bool) -> Rules:
    def manager_refused(request: dict, book: Book, row: dict | None) -> str | None:
        given = request["manager_id"] is not None
        if given and not request["_known"]:
            return NO_MANAGER
        if not request["_active"] and (given or compat):
            return INACTIVE_MANAGER
        # In the compatible form a department's own manager counts as taken too.
        if book.held("_boss", request["_boss"], but=None if compat else row):
            return MANAGER_BUSY
        return None

    def answer(request: dict, book: Book) -> Answer:
        at, action = request["dept_id"], request["_action"]
        row = book.row(at)
        written = {c: request[c] for c in ("dept_name", "manager_id", "_name", "_boss")}
        if action == "insert":
            refused = NAME_EXISTS if book.held("_name", request["_name"]) else manager_refused(request, book, None)
            return (False, refused, None) if refused else (True, "Department added successfully", book.insert(written))
        if action == "update":
            refused = NO_SUCH_DEPARTMENT if row is None else None
            if not refused and book.held("_name", request["_name"], but=row):
                refused = NAME_USED
            refused = refused or manager_refused(request, book, row)
            if not refused:
                book.update(row, written)
            return not refused, refused or "Department updated successfully", at
        if action == "delete":
            refused = NO_SUCH_DEPARTMENT if row is None else STAFFED if request["_staffed"] else None
            if not refused:
                book.delete(row)
            return not refused, refused or "Department deleted successfully", at
        return None

    return answer


def department_changes(changes: DataFrame, department: DataFrame, employee: DataFrame, compat: bool = True) -> JobResult:
    """Add, change and delete departments in request order (``action``: insert, update or delete).

    A change overwrites name and manager. In the compatible form a department's own manager counts as
    already assigned, so saving it again is refused. A department somebody belongs to stays.
    """
    staffed = employee.select("dept_id").distinct().withColumn("_staffed", F.lit(True))
    boss = F.col("manager_id").cast("string")
    managers = _managers(employee).withColumnsRenamed({"known": "_known", "active": "_active"})
    asked = changes.withColumns({"_action": folded("action"), "_name": folded("dept_name"), "_boss": boss})
    asked = asked.join(managers, "manager_id", "left").join(staffed, "dept_id", "left")
    state = department.withColumns({"_name": folded("dept_name"), "_boss": boss})
    outcomes, rows = replay(asked, state, "dept_id", ["_name", "_boss"], _department_rules(compat))
    return JobResult(outcomes, {"department": rows})


def update_departments(requests: DataFrame, department: DataFrame, employee: DataFrame, compat: bool = True) -> JobResult:
    """Rename departments and give them a manager, in request order."""
    return department_changes(requests.withColumn("action", F.lit("update")), department, employee, compat)


def delete_departments(requests: DataFrame, department: DataFrame, employee: DataFrame) -> JobResult:
    """Delete departments nobody belongs to."""
    staffed = employee.select("dept_id").distinct().withColumn("staffed", F.lit(True))
    missing = "Department not found"
    asked = (
        requests.join(department.select("dept_id").withColumn("known", F.lit(True)), "dept_id", "left")
        .join(staffed, "dept_id", "left")
        .withColumn(
            "refused",
            first_failure(
                [
                    (F.col("known").isNull(), missing),
                    (F.col("staffed"), STAFFED),
                ]
            ),
        )
    )
    gone = first_per(asked.filter("refused is null"), ["dept_id"])
    won = F.col("refused").isNull() & F.coalesce(F.col("_first") == turn(), F.lit(False))
    outcomes = asked.join(gone.select("dept_id", turn().alias("_first")), "dept_id", "left").select(
        "request_id",
        won.alias("accepted"),
        F.when(won, "Department deleted successfully").otherwise(F.coalesce("refused", F.lit(missing))).alias("message"),
        "dept_id",
    )
    return JobResult(outcomes, {"department": delete_keys(department, gone, ["dept_id"])})


PHONE_USED = "This phone number is already used by another employee"
EMAIL_USED = "This email address is already used by another employee"
WORKING = "This Employee is already working with us"
NO_DEPARTMENT = "This department does not exist"


def hire(requests: DataFrame, employee: DataFrame, department: DataFrame, as_of: Column) -> JobResult:
    """New employees: unknown ssn, free phone and email, existing department.

    Each request is tested against the table and the employees hired before it in
    the batch.
    """
    person = employee.filter("ssn is not null").groupBy(folded("ssn").alias("_ssn")).agg(
        F.min(F.lower("status")).alias("_status")
    )
    phones = employee.select(folded("phone").alias("_phone")).distinct().withColumn("_phone_used", F.lit(True))
    emails = employee.select(folded("email").alias("_email")).distinct().withColumn("_email_used", F.lit(True))
    departments = department.select("dept_id").withColumn("_dept", F.lit(True))
    rehire = "This Employee cannot be re-hired because he/she is inactive"
    asked = (
        requests.withColumns({"_ssn": folded("ssn"), "_phone": folded("phone"), "_email": folded("email")})
        .join(person, "_ssn", "left")
        .join(phones, "_phone", "left")
        .join(emails, "_email", "left")
        .join(departments, "dept_id", "left")
    )
    tests = [
        (F.col("_status") == "inactive", rehire),
        (F.col("_status") == "active", WORKING),
        (F.col("_phone_used"), PHONE_USED),
        (F.col("_email_used"), EMAIL_USED),
        (F.col("_dept").isNull(), NO_DEPARTMENT),
    ]
    asked = asked.withColumn("refused", first_failure(tests))
    claims = ["_ssn", "_phone", "_email"]
    winners = accept_in_order(asked.filter("refused is null"), claims)
    hired = with_next_ids(
        asked.join(winners.select("request_id"), "request_id", "left_semi"), employee, "emp_id", REQUEST_ORDER
    )
    for claim in claims:
        asked = asked.join(
            winners.filter(F.col(claim).isNotNull()).select(claim, turn().alias(f"_by{claim}")), claim, "left"
        )
    status = asked.select("request_id", (F.lower("status") == "inactive").alias("_by_inactive"))
    hired_as = winners.filter("_ssn is not null").join(status, "request_id").select("_ssn", "_by_inactive")
    asked = asked.join(hired_as, "_ssn", "left")
    # The same tests again, now also against people hired earlier in the batch.
    earlier = F.col("_by_ssn") < turn()
    inactive = F.coalesce("_by_inactive", F.lit(False))
    final = first_failure(
        [
            (F.coalesce(tests[0][0], F.lit(False)) | (earlier & inactive), rehire),
            (F.coalesce(tests[1][0], F.lit(False)) | (earlier & ~inactive), WORKING),
            (tests[2][0] | (F.col("_by_phone") < turn()), PHONE_USED),
            (tests[3][0] | (F.col("_by_email") < turn()), EMAIL_USED),
            tests[4],
        ]
    )
    outcomes = asked.join(hired.select("request_id", "emp_id"), "request_id", "left").select(
        "request_id",
        F.col("emp_id").isNotNull().alias("accepted"),
        F.when(F.col("emp_id").isNotNull(), "Employee Added Successfully").otherwise(final).alias("message"),
        "emp_id",
    )
    today = as_of.cast("date")
    rows = hired.withColumns(
        {
            "salary": money("salary"),
            "start_job": F.coalesce("start_job", today),
            "end_job": F.col("end_job"),
            "status": F.coalesce("status", F.lit("Active")),
        }
    )
    return JobResult(outcomes, {"employee": append(employee, rows)})


REHIRE = "This Employee cannot be re-hired because he/she is inactive"
UNKNOWN = "This employee does not exist"
ALREADY_INACTIVE = "This employee is already inactive"
_WRITTEN = ("phone", "email", "salary", "type", "dept_id", "end_job", "status")


def _held_by_people(df: DataFrame, status: Column) -> DataFrame:
    """The values that people hold: ssn by status, phone, email."""
    ssn = folded("ssn")
    return df.withColumns(
        {
            "_ssn": ssn,
            "_working": F.when(folded(status) == "active", ssn),
            "_left": F.when(folded(status) == "inactive", ssn),
            "_phone": folded("phone"),
            "_email": folded("email"),
        }
    )


def _employee_rules(columns: list[str], today: object) -> Rules:
    def contact_refused(request: dict, book: Book, row: dict | None) -> str | None:
        if book.held("_phone", request["_phone"], but=row):
            return PHONE_USED
        return EMAIL_USED if book.held("_email", request["_email"], but=row) else None

    def with_status(row: dict, status: str) -> dict:
        """The change of a row that gives it another status."""
        kind, ssn = status.rstrip(" ").lower(), row["_ssn"]
        return {"status": status, "_working": ssn if kind == "active" else None, "_left": ssn if kind == "inactive" else None}

    def hire_one(request: dict, book: Book) -> Answer:
        if book.held("_working", request["_ssn"]):
            refused = WORKING
        elif book.held("_left", request["_ssn"]):
            refused = REHIRE
        else:
            refused = contact_refused(request, book, None) or (None if request["_dept"] else NO_DEPARTMENT)
        if refused:
            return False, refused, None
        row = {c: request.get(c) for c in columns} | {c: request[c] for c in ("_ssn", "_phone", "_email")}
        row |= with_status(row, request["status"] or "Active") | {"start_job": request.get("start_job") or today}
        return True, "Employee Added Successfully", book.insert(row)

    def change_one(request: dict, book: Book) -> Answer:
        row = book.row(request["emp_id"])
        refused = UNKNOWN if row is None else None if request["_dept"] else NO_DEPARTMENT
        refused = refused or contact_refused(request, book, row)
        if not refused:
            values = {c: request[c] for c in (*_WRITTEN, "_phone", "_email")}
            book.update(row, values | with_status(row, request["status"] or "Active"))
        return not refused, refused or "Employee Updated Successfully", request["emp_id"]

    def end_one(request: dict, book: Book) -> Answer:
        row = book.row(request["emp_id"])
        if row is None:
            return False, UNKNOWN, request["emp_id"]
        if (row["status"] or "").rstrip(" ").lower() == "inactive":
            return False, ALREADY_INACTIVE, request["emp_id"]
        book.update(row, {**with_status(row, "Inactive"), "end_job": today})
        return True, "Employee deleted (status set to Inactive) successfully", request["emp_id"]

    acts = {"insert": hire_one, "update": change_one, "delete": end_one}

    def answer(request: dict, book: Book) -> Answer:
        act = acts.get(request["_action"])
        return act(request, book) if act else None

    return answer


def employee_changes(changes: DataFrame, employee: DataFrame, department: DataFrame, as_of: Column) -> JobResult:
    """Hire, change and end employees in request order (``action``: insert, update or delete).

    A change overwrites contact, pay, type, department, end date and status: a missing status becomes
    Active and a missing end date is cleared, which brings a former employee back. Ending sets the row
    inactive; it stays. Phone and email belong to one employee at a time.
    """
    today = employee.sparkSession.range(1).select(as_of.cast("date")).first()[0]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in employee.schema if f.name not in changes.columns]
    asked = _held_by_people(changes.select("*", *missing), F.col("status")).withColumn("_action", folded("action"))
    # Whether somebody works, or worked, under a number is asked for whatever the request's own status.
    asked = asked.withColumns({"_working": F.col("_ssn"), "_left": F.col("_ssn")})
    asked = asked.join(department.select("dept_id").withColumn("_dept", F.lit(True)), "dept_id", "left")
    state = _held_by_people(employee, F.col("status"))
    claims = ["_ssn", "_working", "_left", "_phone", "_email"]
    outcomes, rows = replay(asked, state, "emp_id", claims, _employee_rules(employee.columns, today))
    return JobResult(outcomes, {"employee": rows})


def update_employees(requests: DataFrame, employee: DataFrame, department: DataFrame) -> JobResult:
    """Overwrite contact, pay, type, department, end date and status, in request order."""
    return employee_changes(requests.withColumn("action", F.lit("update")), employee, department, F.lit(None))


def terminate(requests: DataFrame, employee: DataFrame, as_of: Column) -> JobResult:
    """Set employees inactive; the row stays."""
    already = "This employee is already inactive"
    asked = requests.join(_people(employee), "emp_id", "left").withColumn(
        "refused",
        first_failure(
            [(F.col("known").isNull(), "This employee does not exist"), (F.col("inactive"), already)]
        ),
    )
    gone = first_per(asked.filter("refused is null"), ["emp_id"])
    won = F.col("refused").isNull() & F.coalesce(F.col("_first") == turn(), F.lit(False))
    outcomes = asked.join(gone.select("emp_id", turn().alias("_first")), "emp_id", "left").select(
        "request_id",
        won.alias("accepted"),
        F.when(won, "Employee deleted (status set to Inactive) successfully")
        .otherwise(F.coalesce("refused", F.lit(already)))
        .alias("message"),
        "emp_id",
    )
    marked = employee.join(gone.select("emp_id").withColumn("_gone", F.lit(True)), "emp_id", "left")
    next_state = marked.select(
        *[
            F.when(F.col("_gone"), F.lit("Inactive")).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(F.col("_gone"), as_of.cast("date")).otherwise(F.col(c)).alias(c)
            if c == "end_job"
            else F.col(c)
            for c in employee.columns
        ]
    )
    return JobResult(outcomes, {"employee": next_state})
