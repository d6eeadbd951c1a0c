"""Mixed batches on master tables against plain loops, in one range and in many."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.frames import frame, table
from wardflow.functions.clock import moment
from wardflow.operators import replay
from wardflow.plans import diagnostics, staffing


@pytest.fixture(params=[20_000, 9])
def ranges(request, monkeypatch):
    """Requests a range: all at once, and so few that a batch has many ranges."""
    monkeypatch.setattr(replay, "RANGE_REQUESTS", request.param)


def answers(result, key):
    return {r["request_id"]: (r["accepted"], r["message"], r[key]) for r in result.outcomes.collect()}


def in_turn(asked):
    return sorted(asked, key=lambda r: (r[1], r[0]))


def plain_catalogue(asked, state, texts, used=(), priced=False):
    rows, top, out = dict(state), max(state, default=0), {}
    for rid, _, action, key, name, price in in_turn(asked):
        action = action.lower()
        holders = [k for k, v in rows.items() if name is not None and v is not None and v.lower() == name.lower()]
        refused = None
        if action == "insert":
            refused = texts.name_exists if holders else diagnostics.NEGATIVE_PRICE if priced and price < 0 else None
            if not refused:
                top += 1
                rows[top] = name
            out[rid] = (not refused, refused or texts.inserted, None if refused else top)
            continue
        if action == "update":
            missing, held = key not in rows, key is not None and any(k != key for k in holders)
            tests = [(missing, texts.missing), (held, texts.name_taken)]
            tests = tests if texts.missing_first else tests[::-1]
            if texts.id_required:
                tests.insert(0, (key is None, texts.id_required))
            refused = next((text for failed, text in tests if failed), None)
            if not refused and name is not None:
                rows[key] = name
            out[rid] = (not refused, refused or texts.updated, key)
        elif action == "delete":
            refused = texts.missing if key not in rows else texts.in_use if key in used else None
            if not refused:
                del rows[key]
            out[rid] = (not refused, refused or texts.deleted, key)
        elif texts.invalid:
            out[rid] = (False, texts.invalid, key)
    return out, rows


def catalogue_requests(seed, n=150):
    draw = random.Random(seed)
    names = [None, *(f"{a}{k}" for k in range(12) for a in "nN")]
    actions = ["Insert", "UPDATE", "delete", "insert", "update", "other"]
    return [(i, draw.randrange(60), draw.choice(actions), draw.choice([None, *range(1, 40)]), draw.choice(names), draw.choice([-1, 5, 5])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shift_changes_match_a_loop(spark, ranges, seed):
    asked, state = catalogue_requests(seed), {i: f"n{i}" for i in range(1, 9)}
    changes = frame(spark, [r[:5] for r in asked], "request_id int, request_ts int, action string, shift_id int, shift_name string")
    shift = frame(spark, list(state.items()), "shift_id int, shift_name string")
    result = staffing.shift_changes(changes, shift, frame(spark, [(1, 2), (2, 12)], "emp_id int, shift_id int"))
    want, rows = plain_catalogue(asked, state, staffing.SHIFT_TEXTS, used={2, 12})
    assert answers(result, "shift_id") == want
    assert {r["shift_id"]: r["shift_name"] for r in result.tables["shift"].collect()} == rows


@pytest.mark.parametrize("job", ["lab", "radiology"])
def test_examinations_match_a_loop(spark, ranges, job):
    key, name, texts = ("test_id", "test_name", diagnostics.LAB_TEXTS) if job == "lab" else ("rad_id", "rad_name", diagnostics.RADIOLOGY_TEXTS)
    asked, state = catalogue_requests(7), {i: f"n{i}" for i in range(1, 9)}
    rows_in = [(*r[:5], Decimal(r[5])) for r in asked]
    changes = frame(spark, rows_in, f"request_id int, request_ts int, action string, {key} int, {name} string, price decimal(10,2)")
    changes = changes.withColumn("delivery_duration", F.lit(None).cast("int"))
    held = frame(spark, [(i, n, 3, Decimal(4)) for i, n in state.items()], f"{key} int, {name} string, delivery_duration int, price decimal(10,2)")
    result = (diagnostics.lab_test_changes if job == "lab" else diagnostics.radiology_changes)(changes, held)
    want, rows = plain_catalogue(asked, state, texts, priced=True)
    assert answers(result, key) == want
    final = next(iter(result.tables.values()))
    assert final.schema == held.schema
    assert {r[key]: r[name] for r in final.collect()} == rows


def test_delete_then_insert_and_rename_then_reuse(spark, ranges):
    shift = frame(spark, [(1, "early"), (2, "late")], "shift_id int, shift_name string")
    asked = [
        (1, 1, "insert", None, "early"),
        (2, 2, "delete", 1, None),
        (3, 3, "insert", None, "Early"),
        (4, 4, "update", 2, "night"),
        (5, 5, "insert", None, "LATE"),
        (6, 6, "update", 3, "late"),
        (7, 7, "delete", 4, None),
        (8, 8, "update", 3, "late"),
    ]
    changes = frame(spark, asked, "request_id int, request_ts int, action string, shift_id int, shift_name string")
    result = staffing.shift_changes(changes, shift, frame(spark, [], "emp_id int, shift_id int"))
    assert [answers(result, "shift_id")[i][0] for i in range(1, 9)] == [False, True, True, True, True, False, True, True]
    assert sorted(map(tuple, result.tables["shift"].collect())) == [(2, "night"), (3, "late")]


def test_empty_batch(spark):
    shift = frame(spark, [(1, "early")], "shift_id int, shift_name string")
    none = frame(spark, [], "request_id int, request_ts int, action string, shift_id int, shift_name string")
    result = staffing.shift_changes(none, shift, frame(spark, [], "emp_id int, shift_id int"))
    assert result.outcomes.count() == 0 and result.tables["shift"].count() == 1


@pytest.mark.parametrize("compat", [True, False])
def test_department_changes_match_a_loop(spark, ranges, compat):
    draw = random.Random(5)
    people = {i: ("active" if i % 5 else "Inactive", i % 4) for i in range(1, 13)}
    employee = table(spark, "employee", [dict(emp_id=i, fname="a", status=s, dept_id=d) for i, (s, d) in people.items()])
    state = {i: (f"d{i}", i if i < 4 else None) for i in range(1, 7)}
    department = table(spark, "department", [dict(dept_id=i, dept_name=n, manager_id=m) for i, (n, m) in state.items()])
    asked = [
        (i, draw.randrange(50), draw.choice(["insert", "update", "update", "delete"]), draw.randrange(1, 20), draw.choice([f"{a}{k}" for k in range(9) for a in "dD"]), draw.choice([None, 99, *people]))
        for i in range(140)
    ]
    changes = frame(spark, asked, "request_id int, request_ts int, action string, dept_id int, dept_name string, manager_id int")
    rows, top, want = dict(state), 6, {}
    for rid, _, action, key, name, boss in in_turn(asked):
        def manager(own=None):
            if boss is not None and boss not in people:
                return staffing.NO_MANAGER
            if (boss is None and compat) or (boss is not None and people[boss][0] != "active"):
                return staffing.INACTIVE_MANAGER
            if boss is not None and any(m == boss for k, (_, m) in rows.items() if compat or k != own):
                return staffing.MANAGER_BUSY
        same = [k for k, (n, _) in rows.items() if n.lower() == name.lower()]
        if action == "insert":
            refused = staffing.NAME_EXISTS if same else manager()
            if not refused:
                top += 1
                rows[top] = (name, boss)
            want[rid] = (not refused, refused or "Department added successfully", None if refused else top)
            continue
        refused = staffing.NO_SUCH_DEPARTMENT if key not in rows else None
        if action == "update":
            refused = refused or (staffing.NAME_USED if any(k != key for k in same) else manager(key))
            if not refused:
                rows[key] = (name, boss)
        else:
            refused = refused or (staffing.STAFFED if any(d == key for _, d in people.values()) else None)
            if not refused:
                del rows[key]
        want[rid] = (not refused, refused or f"Department {action}d successfully", key)
    result = staffing.department_changes(changes, department, employee, compat)
    assert answers(result, "dept_id") == want
    assert {r["dept_id"]: (r["dept_name"], r["manager_id"]) for r in result.tables["department"].collect()} == rows


def test_employee_changes_match_a_loop(spark, ranges):
    draw = random.Random(9)
    start = {i: dict(ssn=f"S{i}", phone=f"p{i}", email=f"m{i}", status="active" if i % 3 else "Inactive") for i in range(1, 9)}
    employee = table(spark, "employee", [dict(emp_id=i, fname="a", type="n", dept_id=1, **r) for i, r in start.items()])
    department = table(spark, "department", [dict(dept_id=1, dept_name="a")])
    asked = []
    for i in range(150):
        pick = lambda letter, n: draw.choice([None, *(f"{a}{k}" for k in range(n) for a in (letter, letter.upper()))])
        asked.append((i, draw.randrange(70), draw.choice(["insert", "update", "delete"]), draw.choice(range(1, 40)), pick("s", 15), pick("p", 15), pick("m", 25), draw.choice([1, 1, 1, 7]), draw.choice([None, "Inactive", "Active", None])))
    changes = frame(spark, asked, "request_id int, request_ts int, action string, emp_id int, ssn string, phone string, email string, dept_id int, status string")
    changes = changes.select("*", F.lit("x").alias("fname"), F.lit("y").alias("lname"), F.lit(5).cast("decimal(10,2)").alias("salary"), F.lit("n").alias("type"), F.lit(None).cast("date").alias("end_job"))
    low = lambda x: x.lower() if x else None
    rows, top, want = {k: dict(v) for k, v in start.items()}, 8, {}
    for rid, _, action, key, ssn, phone, email, dept, status in in_turn(asked):
        def used(field, value, own=None):
            return value is not None and any(low(r[field]) == value.lower() for k, r in rows.items() if k != own)
        contact = lambda own=None: staffing.PHONE_USED if used("phone", phone, own) else staffing.EMAIL_USED if used("email", email, own) else None
        no_dept = staffing.NO_DEPARTMENT if dept != 1 else None
        if action == "insert":
            known = {low(r["status"]) for r in rows.values() if ssn and low(r["ssn"]) == ssn.lower()}
            refused = staffing.WORKING if "active" in known else staffing.REHIRE if known else contact() or no_dept
            if not refused:
                top += 1
                rows[top] = dict(ssn=ssn, phone=phone, email=email, status=status or "Active")
            want[rid] = (not refused, refused or "Employee Added Successfully", None if refused else top)
        elif action == "update":
            refused = staffing.UNKNOWN if key not in rows else no_dept or contact(key)
            if not refused:
                rows[key] |= dict(phone=phone, email=email, status=status or "Active")
            want[rid] = (not refused, refused or "Employee Updated Successfully", key)
        else:
            refused = staffing.UNKNOWN if key not in rows else staffing.ALREADY_INACTIVE if low(rows[key]["status"]) == "inactive" else None
            if not refused:
                rows[key]["status"] = "Inactive"
            want[rid] = (not refused, refused or "Employee deleted (status set to Inactive) successfully", key)
    result = staffing.employee_changes(changes, employee, department, moment("2024-01-10 00:00:00"))
    assert answers(result, "emp_id") == want
    got = {r["emp_id"]: {c: r[c] for c in ("ssn", "phone", "email", "status")} for r in result.tables["employee"].collect()}
    assert got == rows


def test_dependent_ranges_are_replayed_in_proportion(spark, monkeypatch):
    """Each range renames what the range before it named; the ranges replayed must not grow with the square."""
    monkeypatch.setattr(replay, "RANGE_REQUESTS", 2)
    monkeypatch.setattr(replay, "RANGES_AT_ONCE", 3)
    replays, write = [], replay.materialize

    def counted(df, label, *folders):
        done = write(df, label, *folders)
        if label == "replayed":
            replays.append(done.where("_kind = 'answer'").select("_range").distinct().count())
        return done

    monkeypatch.setattr(replay, "materialize", counted)
    asked = [(i, i, "update", 1 + i % 2, f"n{i // 2 % 3}") for i in range(36)]
    state = {1: "n0", 2: "n1"}
    changes = frame(spark, asked, "request_id int, request_ts int, action string, shift_id int, shift_name string")
    shift = frame(spark, list(state.items()), "shift_id int, shift_name string")
    result = staffing.shift_changes(changes, shift, frame(spark, [(1, 9)], "emp_id int, shift_id int"))
    want, rows = plain_catalogue([(*r, 0) for r in asked], state, staffing.SHIFT_TEXTS)
    assert answers(result, "shift_id") == want
    assert {r["shift_id"]: r["shift_name"] for r in result.tables["shift"].collect()} == rows
    assert max(replays) <= 3 and sum(replays) <= 3 * 18


def test_ranges_that_pass_rows_on_are_settled_by_the_window(spark, monkeypatch):
    """Ranges that rename a row, touch it only, or find it deleted agree on it after a few rounds, not one after the other."""
    monkeypatch.setattr(replay, "RANGE_REQUESTS", 4)
    monkeypatch.setattr(replay, "RANGES_AT_ONCE", 8)
    rounds, write = [], replay.materialize

    def counted(df, label, *folders):
        rounds.extend([label] * (label == "replayed"))
        return write(df, label, *folders)

    monkeypatch.setattr(replay, "materialize", counted)
    steps = [s for k in range(31) for s in (("update", 1, None), ("update", 2, f"n{k % 7}"), ("delete", 3, None), ("insert", None, f"x{k // 3}"))]
    asked = [(i, i, *step, 5) for i, step in enumerate(steps)]
    state = {1: "a", 2: "b", 3: "c"}
    rows_in = [(*r[:5], Decimal(r[5])) for r in asked]
    changes = frame(spark, rows_in, "request_id int, request_ts int, action string, test_id int, test_name string, price decimal(10,2)")
    changes = changes.withColumn("delivery_duration", F.lit(None).cast("int"))
    held = frame(spark, [(i, n, 3, Decimal(4)) for i, n in state.items()], "test_id int, test_name string, delivery_duration int, price decimal(10,2)")
    result = diagnostics.lab_test_changes(changes, held)
    want, rows = plain_catalogue(asked, state, diagnostics.LAB_TEXTS, priced=True)
    assert answers(result, "test_id") == want
    assert {r["test_id"]: r["test_name"] for r in result.tables["lab_tests"].collect()} == rows
    assert len(rounds) <= 20


def test_ranges_that_forget_take_two_rounds_a_window(spark, monkeypatch):
    """A batch whose ranges leave the same whatever they begin with is replayed in full windows from the first one on."""
    monkeypatch.setattr(replay, "RANGE_REQUESTS", 4)
    monkeypatch.setattr(replay, "RANGES_AT_ONCE", 8)
    rounds, write = [], replay.materialize

    def counted(df, label, *folders):
        rounds.extend([label] * (label == "replayed"))
        return write(df, label, *folders)

    monkeypatch.setattr(replay, "materialize", counted)
    monkeypatch.setattr(replay, "ROUNDS_APART", 3)
    people = table(spark, "employee", [dict(emp_id=i, fname="a", status="active", dept_id=9) for i in range(1, 5)])
    department = table(spark, "department", [dict(dept_id=i, dept_name=f"d{i}", manager_id=None) for i in (1, 2)])
    # Every range gives both departments a new name and manager, and tries to use a name twice.
    steps = [s for k in range(30) for s in ((1, f"a{k}", 1), (2, f"b{k}", 3), (1, f"a{k}", 2), (2, f"a{k}", 4))]
    asked = [(i, i, *step) for i, step in enumerate(steps)]
    requests = frame(spark, asked, "request_id int, request_ts int, dept_id int, dept_name string, manager_id int")
    result = staffing.update_departments(requests, department, people, compat=False)
    rows, want = {1: ("d1", None), 2: ("d2", None)}, {}
    for rid, _, key, name, boss in asked:
        other = rows[3 - key]
        refused = staffing.NAME_USED if other[0] == name else staffing.MANAGER_BUSY if other[1] == boss else None
        if not refused:
            rows[key] = (name, boss)
        want[rid] = (not refused, refused or "Department updated successfully", key)
    assert answers(result, "dept_id") == want
    assert {r["dept_id"]: (r["dept_name"], r["manager_id"]) for r in result.tables["department"].collect()} == rows
    assert len(rounds) <= 8


@pytest.mark.parametrize("forgetting", [True, False])
def test_first_window_is_wide_and_cut_where_ranges_depend(spark, monkeypatch, forgetting):
    """Ranges that forget take two rounds for all of them; those that depend on each other are soon replayed a range a core."""
    monkeypatch.setattr(replay, "RANGE_REQUESTS", 2)
    replays, write = [], replay.materialize

    def counted(df, label, *folders):
        done = write(df, label, *folders)
        if label == "replayed":
            replays.append(done.where("_kind = 'answer'").select("_range").distinct().count())
        return done

    monkeypatch.setattr(replay, "materialize", counted)
    # New names in every range, or names that the range before has just left.
    asked = [(i, i, "update", 1 + i % 2, f"n{i}" if forgetting else f"n{i // 2 % 3}") for i in range(2, 50)]
    state = {1: "n0", 2: "n1"}
    changes = frame(spark, asked, "request_id int, request_ts int, action string, shift_id int, shift_name string")
    shift = frame(spark, list(state.items()), "shift_id int, shift_name string")
    result = staffing.shift_changes(changes, shift, frame(spark, [(1, 9)], "emp_id int, shift_id int"))
    want, rows = plain_catalogue([(*r, 0) for r in asked], state, staffing.SHIFT_TEXTS)
    assert answers(result, "shift_id") == want
    assert {r["shift_id"]: r["shift_name"] for r in result.tables["shift"].collect()} == rows
    cores = spark.sparkContext.defaultParallelism
    if forgetting:
        assert replays == [24, 23]
    else:
        assert max(replays[replay.FEW_ROUNDS :], default=0) <= cores and sum(replays) <= replay.FEW_ROUNDS * 24 + cores * 24
