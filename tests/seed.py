"""Small staff fixture: six employees, 29 shifts, two open-ended absences."""

# fixed values: id, name, role
EMPLOYEES = [
    ("AK", "Anna K.", "Kassierer"), ("TM", "Thomas M.", "Abteilungsleiter"),
    ("SB", "Sara B.", "Kassierer"), ("MR", "Max R.", "Lagerist"),
    ("LW", "Lisa W.", "Kassierer"), ("KS", "Klaus S.", "Abteilungsleiter"),
]
# fixed values: per employee, weekday -> (start, end) in whole hours
SHIFTS = {
    "AK": {1: (8, 14), 2: (8, 14), 3: (12, 20), 5: (8, 14), 6: (10, 16)},
    "TM": {1: (8, 16), 2: (8, 16), 3: (8, 16), 4: (8, 16), 5: (8, 16)},
    "SB": {1: (10, 18), 3: (10, 18), 4: (10, 18), 5: (10, 18), 6: (8, 14)},
    "MR": {1: (6, 14), 2: (6, 14), 4: (6, 14), 5: (6, 14), 6: (6, 12)},
    "LW": {2: (14, 20), 3: (14, 20), 4: (14, 20), 5: (14, 20), 6: (12, 20)},
    "KS": {3: (12, 20), 4: (12, 20), 5: (12, 20), 6: (10, 18)},
}
ABSENCES = [("SB", "vacation", "2000-01-01", "2999-12-31"),
            ("MR", "sick", "2000-01-01", "2999-12-31")]


def staff(spark, absent=True, site=1):
    employees = spark.createDataFrame(
        [(i, site, n, r, True) for i, n, r in EMPLOYEES],
        "id STRING, site_id BIGINT, name STRING, role STRING, active BOOLEAN")
    shifts = spark.createDataFrame(
        [(i, d, a * 60, b * 60) for i, days in SHIFTS.items() for d, (a, b) in days.items()],
        "employee_id STRING, weekday INT, start_min INT, end_min INT")
    absences = spark.createDataFrame(
        ABSENCES if absent else [],
        "emp_id STRING, type STRING, start_date STRING, end_date STRING")
    return employees, shifts, absences
