from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.functions.parse import Cell, parse_cells

COERCION, AMBIGUOUS = "TYPE_COERCION_FAILED", "DATE_AMBIGUOUS"
CASES = {
    "trim": [("  hi  ", "hi", None), ("   ", None, None), (None, None, None), ("\t x　\n", "x", None)],
    "parse_date": [
        ("2026-01-15", date(2026, 1, 15), None), ("25/12/2025", date(2025, 12, 25), None),
        ("12/25/2025", date(2025, 12, 25), None), ("03/04/2025", None, AMBIGUOUS), ("05/05/2025", None, AMBIGUOUS),
        ("not-a-date", None, COERCION), ("2026-1-5", None, COERCION), ("2026-02-30", None, COERCION),
        ("13/13/2020", None, COERCION), ("00/13/2020", None, COERCION), ("0000-01-01", None, COERCION),
        ("1/13/2020", date(2020, 1, 13), None), ("", None, None), (None, None, None),
    ],
    "to_int": [("42", 42, None), ("+5", 5, None), ("1_000", 1000, None), ("abc", None, COERCION), ("1.5", None, COERCION), (" ", None, None)],
    "to_minor_units": [
        ("100.00", 10000, None), ("$1,234.56", 123456, None), ("1.234,56", 123456, None), ("-450.00", -45000, None),
        ("not-money", None, COERCION), (None, None, None), ("1,234", 123400, None), ("12,34", 1234, None),
        ("1,234,56", None, COERCION), ("-$5", -500, None), ("$-5", -500, None), ("--5", 500, None), ("NaN", None, COERCION),
        ("1e3", 100000, None), ("(5.00)", None, COERCION), ("5 USD", None, COERCION), ("0.005", 1, None),
        ("0.0049999999", 0, None), ("-0.005", -1, None), ("1.234.567,89", 123456789, None), ("1,2.3,4", None, COERCION),
        ("- 5", -500, None), ("€ 12", 1200, None),
    ],
    "map_enum": [("OPEN", "open", None), (" paid ", "paid", None), ("bogus", None, "ENUM_INVALID"), (None, None, None)],
}


@pytest.mark.parametrize("function", CASES)
def test_parser(spark, function):
    cases = CASES[function]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    out = parse_cells(df, {"p": Cell(function, F.col("v"), ("open", "paid"))}).orderBy("i").collect()
    assert [(r.p_raw, r.p_value, r.p_code) for r in out] == cases
