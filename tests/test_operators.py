import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.frames import D, TS, frame, many_ranges, rows
from wardflow.functions import clock, money
from wardflow.functions.text import folded, full_name, joined
from wardflow.operators import intervals, layout, quality, snapshots
from wardflow.operators.scan import number_rows, running, with_next_ids
from wardflow.operators.text import concat_by, report_lines
from wardflow.operators.unique import accept_in_order
from wardflow.plans import reports


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_minutes_count_boundaries(spark):
    r = one(
        spark,
        over=clock.minutes_between_clocks(F.lit(32459), F.lit(32460)),
        inside=clock.minutes_between_clocks(F.lit(32400), F.lit(32459)),
        back=clock.minutes_between_clocks(F.lit(32460), F.lit(32459)),
        stamps=clock.minutes_between(clock.moment("2024-01-01 09:00:59"), clock.moment("2024-01-01 09:01:00")),
    )
    assert (r.over, r.inside, r.back, r.stamps) == (1, 0, -1, 1)


def test_clock_and_calendar(spark):
    r = one(
        spark,
        short=clock.clock_seconds(F.lit("9:05")),
        midnight=clock.clock_seconds(F.lit("0:00")),
        full=clock.clock_seconds(F.lit("17:00:09")),
        text=clock.clock_text(F.lit(34200)),
        day=clock.weekday(F.lit("2024-01-06").cast("date")),
        at=clock.at_time(F.lit("2024-01-06").cast("date"), F.lit(61200)),
        first=clock.day_first_text(clock.moment("2025-12-01 10:00:00")),
    )
    assert (r.short, r.midnight, r.full, r.text, r.day) == (32700, 0, 61209, "09:30", "Saturday")
    assert r["at"] == TS(2024, 1, 6, 17) and r["first"] == "01/12/2025"


@pytest.mark.parametrize(
    "delay,early,amount,label",
    [
        (0, 0, None, None),
        (1, 0, "33.33", "Delay < 1h (1 min)"),
        (59, 0, "33.33", "Delay < 1h (59 min)"),
        (60, 0, "166.67", "Delay >= 1h (60 min)"),
        (0, 1, "166.67", "Early Leave (1 min)"),
        (5, 7, "333.33", "Full day deduction: Delay (5 min) & Early Leave (7 min)"),
    ],
)
def test_penalty(spark, delay, early, amount, label):
    pay = F.lit(Decimal("10000.00"))
    r = one(
        spark,
        amount=money.penalty_amount(F.lit(delay), F.lit(early), pay),
        label=money.penalty_label(F.lit(delay), F.lit(early)),
    )
    assert r.amount == (Decimal(amount) if amount else None) and r["label"] == label


def test_room_payment_bills_at_least_a_day(spark):
    def paid(start, end):
        columns = [F.lit(d).cast("date") for d in (start, end)]
        return one(spark, x=money.room_payment(*columns, F.lit(Decimal("1500.00")))).x

    assert paid("2024-01-01", "2024-01-01") == 1500
    assert paid("2024-01-01", "2024-01-04") == 4500
    assert paid("2024-01-02", "2024-01-01") == 1500


def test_text_and_nulls(spark):
    r = one(
        spark,
        name=full_name(F.lit("A"), F.lit(None).cast("string")),
        glued=joined(F.lit("A"), F.lit(None).cast("string"), F.lit(3)),
        same=folded(F.lit("ICU  ")) == folded(F.lit("icu")),
    )
    assert (r.name, r.glued, r.same) == (None, "A3", True)


def test_running_matches_a_loop_with_a_hot_key(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", f"k{i}"]), rng.randrange(100), i, rng.randrange(9)) for i in range(600)]
    df = frame(spark, data, "k string, t int, id int, v int")
    with many_ranges(spark):
        out = running(
            df,
            ["k"],
            ["t", "id"],
            {"total": ("sum", F.col("v")), "n": ("count", F.lit(1)), "top": ("max", F.col("v"))},
            following={"next_t": ("min", F.col("t"))},
        ).collect()
    by_key = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(row[0], []).append(row)
    expected = {}
    for group in by_key.values():
        for i, row in enumerate(group):
            head, tail = group[: i + 1], group[i + 1 :]
            expected[row[2]] = (sum(h[3] for h in head), i + 1, max(h[3] for h in head), min((x[1] for x in tail), default=None))
    assert {r.id: (r.total, r.n, r.top, r.next_t) for r in out} == expected


def test_running_without_the_current_row(spark):
    df = frame(spark, [("a", i, i) for i in range(50)], "k string, t int, v int")
    with many_ranges(spark):
        out = running(df, ["k"], ["t"], {"before": ("sum", F.col("v"))}, inclusive=False).collect()
    assert {r.t: r.before for r in out} == {i: (sum(range(i)) if i else None) for i in range(50)}


def test_running_in_blocks_matches_a_loop_and_leaves_rows_in_their_block(spark):
    rng = random.Random(6)
    data = [(at, k, rng.choice([None, 1, 2, 7])) for at in range(200) for k in rng.sample(["hot", "a", "b", f"k{at}"], 3)]
    df = frame(spark, data, "at int, k string, v int").withColumn("block", F.floor(F.col("at") / 16))
    with many_ranges(spark):
        out = running(df, ["k"], ["at"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, block="block")
        found = out.collect()
        grouped = out.groupBy("at", "block").agg(F.sum("total").alias("total"))
        assert "hashpartitioning(at" not in grouped._jdf.queryExecution().executedPlan().toString()
        sums = {r["at"]: r["total"] for r in grouped.collect()}
    held, expected = {}, {}
    for at, k, v in data:
        held.setdefault(k, []).append(v)
        known = [x for x in held[k] if x is not None]
        expected[at, k] = (sum(known) if known else None, max(known, default=None))
    assert {(r["at"], r["k"]): (r["total"], r["top"]) for r in found} == expected and len(found) == len(data)
    for at in range(200):
        known = [total for (place, _), (total, _) in expected.items() if place == at and total is not None]
        assert sums[at] == (sum(known) if known else None)


def test_numbers_are_dense_over_many_ranges(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    df = frame(spark, [(i,) for i in ids], "id int")
    with many_ranges(spark):
        out = number_rows(df, ["id"], "n").collect()
    assert sorted((r.id, r.n) for r in out) == [(i, i + 1) for i in range(1000)]


def test_next_ids_follow_the_highest_and_start_at_one(spark):
    rows_ = frame(spark, [(5, 2), (6, 1)], "request_id int, t int")
    state = frame(spark, [(7,), (3,)], "id int")
    assert rows(with_next_ids(rows_, state, "id", ["t"]), "request_id", "id") == [(5, 9), (6, 8)]
    assert rows(with_next_ids(rows_, state.limit(0), "id", ["t"]), "request_id", "id") == [(5, 2), (6, 1)]


def accept_loop(requests):
    taken, accepted = [set(), set()], []
    for rid, _, *claims in sorted(requests, key=lambda r: (r[1], r[0])):
        if all(c is None or c not in t for c, t in zip(claims, taken)):
            accepted.append(rid)
            for c, t in zip(claims, taken):
                if c is not None:
                    t.add(c)
    return sorted(accepted)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_accept_in_order_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.randrange(40), rng.choice([None, *"abcdefghijklmnop"]), rng.choice([None, *range(20)])) for i in range(120)]
    df = frame(spark, data, "request_id int, request_ts int, x string, y int")
    assert sorted(r.request_id for r in accept_in_order(df, ["x", "y"]).collect()) == accept_loop(data)


def test_chain_of_refusals(spark):
    # 2 loses to 1, so 3 (which clashes with 2 only) is free, and 4 clashes with 3.
    data = [(1, 1, "p", 1), (2, 2, "p", 2), (3, 3, "q", 2), (4, 4, "q", 3)]
    df = frame(spark, data, "request_id int, request_ts int, x string, y int")
    assert sorted(r.request_id for r in accept_in_order(df, ["x", "y"]).collect()) == [1, 3]


def test_self_conflicts_match_all_pairs(spark):
    rng = random.Random(9)
    data = [(i, rng.choice("aab"), s := rng.randrange(500), s + rng.randrange(12)) for i in range(150)]
    df = frame(spark, data, "id int, k string, s int, e int")
    with many_ranges(spark):
        found = {r.id for r in intervals.self_conflicts(df, ["k"], "s", "e", "id").collect()}
    expected = {a[0] for a in data for b in data if a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert found == expected and expected


def test_overlapping_matches_all_pairs(spark):
    rng = random.Random(4)
    slots = [(rng.choice("ab"), s := rng.randrange(900), s + rng.randrange(6)) for _ in range(80)]
    asks = [(i, rng.choice("abc"), s := rng.randrange(900), s + rng.randrange(6)) for i in range(120)]
    with many_ranges(spark):
        out = intervals.overlapping(
            frame(spark, asks, "id int, k string, s int, e int"), frame(spark, slots, "k string, s int, e int"), ["k"], "s", "e", "id"
        ).collect()
    assert sorted(r.id for r in out) == [a[0] for a in asks if any(a[1] == b[0] and a[2] <= b[2] and b[1] <= a[3] for b in slots)]


def test_on_duty_plain_and_wrapped(spark):
    slots = frame(spark, [(1, 32400, 57600), (2, 61200, 0), (3, 79200, 21600), (4, 36000, 36000)], "id int, s int, e int")

    def on(at, wrap):
        return [r.id for r in slots.filter(intervals.on_duty(F.lit(at), "s", "e", wrap)).orderBy("id").collect()]

    assert on(36000, False) == [1, 4] and on(36000, True) == [1]
    assert on(64800, False) == [] and on(64800, True) == [2]
    assert on(0, True) == [2, 3] and on(82800, True) == [2, 3] and on(3600, True) == [3]


def test_snapshots(spark):
    state = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    source = frame(spark, [(2, "B"), (9, "Z")], "id int, v string")
    assert rows(snapshots.replace_keys(state, source, ["id"])) == [(1, "a"), (2, "B"), (3, "c"), (9, "Z")]
    assert rows(snapshots.update_from(state, source, ["id"], {"v": "v"})) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(snapshots.upsert(state, source, ["id"])) == [(1, "a"), (2, "B"), (3, "c"), (9, "Z")]
    assert rows(snapshots.upsert(state, source, ["id"], keep=["v"])) == [(1, "a"), (2, "b"), (3, "c"), (9, "Z")]
    assert rows(snapshots.set_by_keys(state, "v", "id", {(1, 2): "x"})) == [(1, "x"), (2, "x"), (3, "c")]
    assert rows(snapshots.tagged_union({"n": state, "o": source.limit(0)}, "tag"), "tag", "id")[0] == ("n", 1)


def files_of(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_only_touched_ranges_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    state = frame(spark, [(n, f"v{n}") for n in range(-10, 90)] + [(None, "none")], "id long, v string")
    layout.create(state, path, "id", 10)
    assert len(list((tmp_path / "t").glob("key_range=*"))) == 11
    before = files_of(tmp_path / "t")
    source = frame(spark, [(12, "A"), (-3, "B"), (205, "C")], "id long, v string")
    changed = layout.rewrite(path, state, source, "id", 10, lambda old, new: snapshots.upsert(old, new, ["id"]))
    assert changed == 3
    want = sorted([r for r in rows(snapshots.upsert(state, source, ["id"]))], key=str)
    assert sorted(rows(layout.read(state, path)), key=str) == want and layout.read(state, path).schema == state.schema
    after = files_of(tmp_path / "t")
    touched = ("key_range=1/", "key_range=-1/", "key_range=20/")
    untouched = {f: at for f, at in before.items() if not any(x in f for x in touched)}
    assert len(untouched) >= 9 and untouched.items() <= after.items()
    assert not any(f in after for f in before if f not in untouched)
    again = layout.rewrite(path, state, source, "id", 10, lambda old, new: snapshots.upsert(old, new, ["id"]))
    assert again == 3 and sorted(rows(layout.read(state, path)), key=str) == want


def test_emptied_ranges_lose_their_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    state = frame(spark, [(n, f"v{n}") for n in range(30)], "id long, v string")
    layout.create(state, path, "id", 10)
    gone = frame(spark, [(n, "x") for n in range(10, 20)] + [(3, "x"), (77, "x")], "id long, v string")
    assert layout.rewrite(path, state, gone, "id", 10, lambda old, new: snapshots.delete_keys(old, new, ["id"])) == 3
    assert [r[0] for r in rows(layout.read(state, path))] == [n for n in range(30) if not 10 <= n < 20 and n != 3]
    assert not (tmp_path / "t" / "key_range=1").exists()
    kept = files_of(tmp_path / "t")
    assert layout.rewrite(path, state, gone.limit(0), "id", 10, lambda old, new: new) == 0
    with pytest.raises(ValueError):
        layout.rewrite(path, state, gone.where("id = 3"), "id", 10, lambda old, new: new.withColumn("id", F.lit(25).cast("long")))
    assert files_of(tmp_path / "t") == kept


def test_ranges_of_keys(spark):
    keys = [-(1 << 63) + 20, -11, -10, -1, 0, 9, 10, (1 << 53) + 1, (1 << 63) - 1, None]
    got = frame(spark, [(k,) for k in keys], "k long").select("k", layout.range_of("k", 10).alias("r"))
    assert {r["k"]: r["r"] for r in got.collect()} == {k: layout.NO_KEY if k is None else k // 10 for k in keys}
    some = frame(spark, [(k,) for k in (-7, 0, 92)], "k long")
    assert layout.width_for(some, "k", 4) == 25 and layout.width_for(some.limit(0), "k", 4) == 1


def test_month_sketches_merge(spark):
    ddl = "reservation_id long, p_id long, date_time timestamp"
    visits = [(n, n * 7919 % 6000, TS(2024, 1 + n % 2, 1 + n % 28)) for n in range(20000)] + [(1, None, TS(2024, 5, 1))]
    older, newer = frame(spark, visits[:12000], ddl), frame(spark, visits[8000:], ddl)
    parts = [reports.patient_month_sketches(df) for df in (older, newer)]
    got = {r["month"]: r["new_patients"] for r in reports.monthly_new_patients_estimate(reports.merge_month_sketches(*parts), n=None).collect()}
    exact = {}
    for _, p, at in visits:
        exact.setdefault(at.strftime("%Y-%m"), set()).update({p} - {None})
    assert got.keys() == exact.keys() and got["2024-05"] == 0
    assert all(abs(got[m] - len(own)) <= 0.065 * len(own) for m, own in exact.items())
    assert [r["month"] for r in reports.monthly_new_patients_estimate(parts[0], n=1).collect()][0] in got


def test_text_lists(spark):
    df = frame(spark, [(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, o int, v string")
    assert rows(concat_by(df, ["k"], F.col("v"), " , ", ["o"], "x")) == [(1, "a , b"), (2, "")]
    assert rows(report_lines(df.filter("k = 1"), ["k"], F.col("v"), ["o"], "x")) == [(1, "a\rb\r")]


def test_quality(spark):
    df = frame(
        spark,
        [(1, "x", 5, D(2024, 1, 1), D(2024, 1, 2)), (1, "Y", -1, D(2024, 1, 2), D(2024, 1, 2)), (None, "z", None, None, None)],
        "id int, kind string, n int, a date, b date",
    )
    assert rows(quality.duplicate_keys(df, ["id"])) == [(1, 2)]
    assert rows(quality.outside_list(df, "kind", ["X", "y"]), "kind") == [("z",)]
    assert rows(quality.outside_range(df, {"n": F.col("n") >= 0}), "kind", "broken") == [("Y", "n")]
    assert rows(quality.unordered_pairs(df, "a", "b"), "kind") == [("Y",)]
    assert rows(quality.missing_values(df, ["id", "n"])) == [("id", 1), ("n", 1)]
    parents = frame(spark, [(1,)], "id int")
    child = frame(spark, [(1, "a"), (2, "b"), (None, "c")], "pid int, v string")
    assert rows(quality.orphans(child, parents, "pid", "id"), "v") == [("b",)]
    assert rows(quality.cascade_delete(child, parents, "pid", "id"), "v") == [("b",), ("c",)]
    assert rows(quality.set_null(child, parents, "pid", "id")) == [(2, "b"), (None, "a"), (None, "c")]
    filled = quality.fill_defaults(df, {"n": F.lit(0)})
    assert filled.filter("n is null").count() == 0
    assert dt.date(2024, 1, 1) == D(2024, 1, 1)


def test_scratch_tables_live_until_cleared(spark):
    from wardflow.session import clear_scratch, materialize, scratch_dir

    clear_scratch(spark)
    kept = materialize(frame(spark, [(1,)], "id int"), "kept")
    assert rows(kept) == [(1,)] and kept.inputFiles()[0].replace("file://", "").startswith(scratch_dir(spark))
    assert clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    with pytest.raises(Exception):
        kept.collect()


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from wardflow.session import scratch_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        scratch_dir(session)
    session.conf.get = lambda key, default: "hdfs://shared/folder/"
    assert scratch_dir(session) == "hdfs://shared/folder"


@pytest.mark.parametrize("wrap", [False, True])
def test_lowest_on_duty_matches_a_loop(spark, wrap):
    """Slots of every shape, also over midnight, of equal ends and of one second."""
    from wardflow.operators.intervals import lowest_on_duty

    draw = random.Random(4)
    times = [0, 1, 2, 63, 64, 43_200, 65_535, 65_536, 86_398, 86_399, *(draw.randrange(86_400) for _ in range(30))]
    slots = [(draw.randrange(3), draw.choice(times), draw.choice(times), draw.randrange(50)) for _ in range(120)]
    slots += [(0, None, 5, 1), (1, 5, None, 1)]
    asked = [(i, draw.choice([0, 1, 2, 7, None]), t) for i, t in enumerate(times * 2)]
    got = lowest_on_duty(
        frame(spark, asked, "id int, k int, clock int"), frame(spark, slots, "k int, a int, b int, who int"), ["k"], "clock", "a", "b", ["who"], "pick", wrap
    )

    def covers(a, b, t):
        if a is None or b is None:
            return False
        if not wrap or a < b:
            return a <= t <= b
        return a > b and (t >= a or t <= b)

    want = {i: min((who for kk, a, b, who in slots if kk == k and covers(a, b, t)), default=None) for i, k, t in asked}
    assert {r["id"]: r["pick"]["who"] if r["pick"] else None for r in got.collect()} == want
