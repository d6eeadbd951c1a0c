"""Column layouts of the hospital tables.

Types: times of day are INT seconds, wall-clock times TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql.types import StructType


TABLES: dict[str, str] = {
    "patient": "p_id INT NOT NULL, fname STRING NOT NULL, lname STRING NOT NULL, email STRING, "
    "birth_date DATE NOT NULL, gender STRING NOT NULL, phone STRING, ssn STRING",
    "employee": "emp_id INT NOT NULL, fname STRING NOT NULL, lname STRING NOT NULL, email STRING, "
    "birth_date DATE NOT NULL, gender STRING NOT NULL, phone STRING, ssn STRING, salary DECIMAL(10,2) NOT NULL, "
    "type STRING NOT NULL, dept_id INT, start_job DATE NOT NULL, end_job DATE, status STRING NOT NULL",
    "department": "dept_id INT NOT NULL, dept_name STRING NOT NULL, manager_id INT",
    "doctor_appointments": "id INT NOT NULL, examination_price INT NOT NULL, day STRING NOT NULL, "
    "shift_start INT NOT NULL, shift_end INT NOT NULL, emp_id INT NOT NULL, dept_id INT",
    "appointment_reservation": "reservation_id INT NOT NULL, date_time TIMESTAMP_NTZ NOT NULL, paid_money DECIMAL(10,2), "
    "p_id INT NOT NULL, dept_id INT NOT NULL, doctor_id INT NOT NULL, receptionist_id INT",
    "attendance": "attend_id INT NOT NULL, emp_id INT NOT NULL, checkin TIMESTAMP_NTZ NOT NULL, "
    "checkout TIMESTAMP_NTZ, attend_date DATE NOT NULL",
    "shift": "shift_id INT NOT NULL, shift_name STRING",
    "shift_appointment": "shift_id INT NOT NULL, shift_type STRING NOT NULL, date DATE NOT NULL, "
    "start_time INT NOT NULL, end_time INT NOT NULL",
    "emp_shift": "emp_id INT NOT NULL, shift_id INT NOT NULL",
    "salary": "id INT NOT NULL, emp_id INT NOT NULL, salary DECIMAL(18,2) NOT NULL, total_reward DECIMAL(18,2), "
    "total_deduction DECIMAL(18,2), date DATE NOT NULL",
    "deduction": "id INT NOT NULL, emp_id INT NOT NULL, type STRING NOT NULL, date DATE NOT NULL, amount DECIMAL(18,2) NOT NULL",
    "reward": "id INT NOT NULL, emp_id INT NOT NULL, type STRING NOT NULL, date DATE NOT NULL, amount DECIMAL(18,2) NOT NULL",
    "expenses": "id INT NOT NULL, date DATE NOT NULL, expense_id INT, amount DECIMAL(10,2)",
    "expenses_type": "expense_id INT NOT NULL, expense_type STRING NOT NULL",
    "lab_tests": "test_id INT NOT NULL, test_name STRING NOT NULL, delivery_duration INT NOT NULL, price DECIMAL(10,2) NOT NULL",
    "radiology": "rad_id INT NOT NULL, rad_name STRING NOT NULL, delivery_duration INT NOT NULL, price DECIMAL(10,2) NOT NULL",
    "lab_reservation": "reservation_id INT NOT NULL, date DATE NOT NULL, paid_money DECIMAL(10,2), p_id INT NOT NULL, "
    "doctor_id INT, test_name STRING, receptionist_id STRING",
    "radio_reservation": "reservation_id INT NOT NULL, date DATE NOT NULL, paid_money DECIMAL(10,2), p_id INT NOT NULL, "
    "doctor_id INT, rad_name STRING, receptionist_id STRING",
    "test_reserve": "test_id INT NOT NULL, reservation_id INT NOT NULL, test_result STRING",
    "rad_reserve": "rad_id INT NOT NULL, reservation_id INT NOT NULL, test_result STRING",
    "diagnose_history": "dig_id INT NOT NULL, dig_description STRING NOT NULL, p_id INT NOT NULL, emp_id INT NOT NULL",
    "prescription": "prescription_id INT NOT NULL, date DATE NOT NULL, notes STRING, p_id INT NOT NULL, "
    "reservation_id INT NOT NULL, drug_name STRING",
    "prescription_drugs": "prescription_id INT NOT NULL, drug_id INT NOT NULL, quantity INT, total_price DECIMAL(10,2)",
    "pharmacy_drugs": "drug_id INT NOT NULL, drug_name STRING NOT NULL, barcode STRING, quantity INT NOT NULL, "
    "exp_date DATE NOT NULL, prod_date DATE NOT NULL, price DECIMAL(10,2) NOT NULL",
    "drug_purchases": "purchase_id INT NOT NULL, drug_name STRING NOT NULL, quantity INT NOT NULL, "
    "unit_cost DECIMAL(10,2) NOT NULL, purchase_date DATE, total DECIMAL(10,2)",
    "low_stock_alerts": "alert_id INT NOT NULL, drug_id INT, drug_name STRING, current_qty INT, alert_date TIMESTAMP_NTZ",
    "room": "room_id INT NOT NULL, room_type STRING NOT NULL, price_per_day DECIMAL(10,2)",
    "room_status": "room_id INT NOT NULL, status STRING",
    "room_reservation": "reservation_id INT NOT NULL, paid_money DECIMAL(10,2), checkin DATE NOT NULL, checkout DATE, "
    "p_id INT NOT NULL, room_id INT NOT NULL, emp_id INT NOT NULL, status STRING",
    "surgery": "surgery_id INT NOT NULL, surgery_name STRING NOT NULL, duration INT NOT NULL, price DECIMAL(10,2) NOT NULL",
    "surgery_reservation": "reservation_id INT NOT NULL, surgery_date DATE NOT NULL, start_time INT NOT NULL, "
    "end_time INT NOT NULL, paid_money DECIMAL(10,2), p_id INT NOT NULL, surgery_id INT NOT NULL, room_id INT NOT NULL, "
    "stuff_id INT NOT NULL, doctor_id INT, receptionist_id INT, status STRING",
    "stuff": "stuff_id INT NOT NULL, stuff_name STRING NOT NULL",
    "stuff_emp": "stuff_id INT NOT NULL, emp_id INT NOT NULL",
    "invoice": "invoice_id INT NOT NULL, date DATE NOT NULL, payment_method STRING NOT NULL, paid_money DECIMAL(10,2), "
    "p_id INT NOT NULL, emp_id INT NOT NULL",
    "invoice_details": "invoice_details_id INT NOT NULL, invoice_id INT NOT NULL, reservation_id INT NOT NULL, "
    "reservation_type STRING NOT NULL, process_id INT NOT NULL, unit_price DECIMAL(10,2), quantity INT, "
    "total DECIMAL(12,2), dept_id INT",
    "dim_type": "type_id INT NOT NULL, type_name STRING",
    "stg_reward_deduction": "rd_id INT NOT NULL, emp_id INT, rd_type STRING, amount DECIMAL(18,2), rd_date DATE",
}


def table_schema(name: str) -> StructType:
    """Layout of a table; needs a running session."""
    return StructType.fromDDL(TABLES[name])
