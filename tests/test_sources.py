"""Seed-file readers on made-up rows."""

from decimal import Decimal

import pytest

from tests.frames import D, frame, rows
from wardflow.sources import loaders

BOM = "﻿"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_patients_keep_leading_zeros(spark, tmp_path):
    path = write(tmp_path / "p.csv", "1,Ann,Bee,a@x.org,1990-01-24,Female,0100,007\n")
    df = loaders.read_table(spark, path, "patient")
    assert rows(df) == [(1, "Ann", "Bee", "a@x.org", D(1990, 1, 24), "Female", "0100", "007")]


def test_drugs_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "d.csv", f"{BOM}1,Pill,99,5,2027-11-27,2025-10-13,81\n2,Pill ,98,0,2027-1-2,2025-10-13,1.5\n")
    df = loaders.read_table(spark, path, "pharmacy_drugs")
    assert rows(df, "drug_id", "drug_name", "exp_date", "price") == [
        (1, "Pill", D(2027, 11, 27), Decimal("81.00")), (2, "Pill", D(2027, 1, 2), Decimal("1.50"))
    ]


def test_schedules_with_short_times_and_dates(spark, tmp_path):
    slots = write(tmp_path / "s.csv", "1,200,Saturday,9:00,16:00,1,1\n2,200,Saturday,17:00,0:00,2,1\n")
    assert rows(loaders.read_table(spark, slots, "doctor_appointments"), "shift_start", "shift_end") == [(32400, 57600), (61200, 0)]
    shifts = write(tmp_path / "a.csv", "1,morning,2025-11-1,12:00,00:00\n")
    assert rows(loaders.read_table(spark, shifts, "shift_appointment")) == [(1, "morning", D(2025, 11, 1), 43200, 0)]


@pytest.mark.parametrize(
    "layout,line",
    [
        ("plain", "1,Ann,Bee,a@x.org,20/02/1979,Female,010,77,doctor,9/1/2025,Active,20000,1\n"),
        ("merged", f"{BOM}Merged\n1,Ann,Bee,a@x.org,20/02/1979,Female,10,77,20000,doctor,1,09/01/2025,Active\n"),
    ],
)
def test_employees_in_both_layouts(spark, tmp_path, layout, line):
    df = loaders.read_employees(spark, write(tmp_path / "e.csv", line), layout)
    assert rows(df, "emp_id", "birth_date", "salary", "type", "dept_id", "start_job", "end_job", "status") == [
        (1, D(1979, 2, 20), Decimal("20000.00"), "doctor", 1, D(2025, 1, 9), None, "Active")
    ]


def test_code_lists(spark, tmp_path):
    rooms = write(tmp_path / "r.csv", "1,normal,500\n2,vip,900\n")
    assert rows(loaders.read_codes(spark, rooms, "room")) == [(1, "normal", Decimal("500.00")), (2, "vip", Decimal("900.00"))]
    hours = write(tmp_path / "o.csv", "1,Op,2,14000\n")
    assert rows(loaders.read_table(spark, hours, "surgery", duration_unit="hours"), "duration") == [(120,)]
    assert rows(loaders.read_table(spark, hours, "surgery"), "duration") == [(2,)]
    for layout, text in (
        ("lab_tests", "1,CBC,2,100\n"), ("radiology", "1,Scan,2,1000\n"), ("department", "1,Lab,2\n"), ("emp_shift", "46,1\n")
    ):
        assert loaders.read_codes(spark, write(tmp_path / f"{layout}.csv", text), layout).count() == 1


def test_inline_rows(spark):
    assert loaders.expense_types(spark).count() == 8
    assert rows(loaders.surgery_teams(spark))[5] == (6, "Surgery Team 6")


def test_snapshots_are_never_overwritten(spark, tmp_path):
    df = frame(spark, [(1, "a")], "shift_id int, shift_name string")
    loaders.write_snapshot(df, str(tmp_path), "shift")
    with pytest.raises(Exception):
        loaders.write_snapshot(df, str(tmp_path), "shift")
    loaders.append_rows(df, str(tmp_path), "shift")
    assert rows(loaders.read_snapshot(spark, str(tmp_path), "shift")) == [(1, "a"), (1, "a")]
