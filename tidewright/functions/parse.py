"""Typed parsing with error capture.

Every parser turns one nullable string into a typed value or an error code.
Null and blank text is no error here: it yields (null, null).

A parser is a short chain of projections (`text`, helper columns, `value`), not
one nested expression: helpers are used several times, and separate projections
let Catalyst evaluate each of them once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import strip, strip_to_null

COERCION = "TYPE_COERCION_FAILED"
AMBIGUOUS = "DATE_AMBIGUOUS"
BAD_ENUM = "ENUM_INVALID"

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
DAY_FIRST = r"^(1[3-9]|[2-9]\d)/\d{1,2}/\d{4}$"
MONTH_FIRST = r"^\d{1,2}/(1[3-9]|[2-9]\d)/\d{4}$"
INTEGER = r"^[+-]?\d+(_\d+)*$"
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COMMA_DECIMAL = r"\.[^.]*,[^.]*$"
LONE_COMMA_DECIMAL = r",([^,]{2})$"
CURRENCY_SYMBOLS = "$€£¥"

Step = Callable[[Mapping[str, Column]], Mapping[str, Column]]


@dataclass(frozen=True)
class Cell:
    """One cell to parse: the parser's name, the raw text, the allowed values."""

    function: str
    raw: Column
    enum_values: Sequence[str] = field(default=())


def _trim_value(c: Mapping[str, Column]) -> Mapping[str, Column]:
    return {"value": c["text"]}


def _date_text(c: Mapping[str, Column]) -> Mapping[str, Column]:
    """ISO form of the text; null when the shape is wrong or day and month are
    interchangeable (also when they are equal): the parser never guesses."""
    text = c["text"]
    first, second, year = (F.split_part(text, F.lit("/"), F.lit(i)) for i in (1, 2, 3))
    day_first = F.concat_ws("-", year, F.lpad(second, 2, "0"), first)
    month_first = F.concat_ws("-", year, F.lpad(first, 2, "0"), second)
    return {
        "iso": F.when(text.rlike(ISO_DATE), text)
        .when(text.rlike(DAY_FIRST), day_first)
        .when(text.rlike(MONTH_FIRST), month_first)
    }


def _date_value(c: Mapping[str, Column]) -> Mapping[str, Column]:
    return {"value": F.when(~c["iso"].startswith("0000"), c["iso"].try_cast("date"))}


def _int_value(c: Mapping[str, Column]) -> Mapping[str, Column]:
    text = c["text"]
    return {"value": F.when(text.rlike(INTEGER), F.translate(text, "_", "").try_cast("bigint"))}


def _money_number(c: Mapping[str, Column]) -> Mapping[str, Column]:
    """Of `,` and `.` the later one is the decimal mark; with commas alone, the
    last is one if exactly two characters follow it."""
    negative = c["bare"].startswith("-")
    body = F.when(negative, c["bare"].substr(2, 2**30)).otherwise(c["bare"])
    plain = (
        F.when(~body.contains(","), body)
        .when(body.rlike(COMMA_DECIMAL), F.translate(F.translate(body, ".", ""), ",", "."))
        .when(~body.contains(".") & body.rlike(LONE_COMMA_DECIMAL),
              F.regexp_replace(body, LONE_COMMA_DECIMAL, ".$1"))
        .otherwise(F.translate(body, ",", ""))
    )
    return {"negative": negative, "number": F.translate(plain, "_", "")}


def _money_value(c: Mapping[str, Column]) -> Mapping[str, Column]:
    amount = F.when(c["number"].rlike(DECIMAL), c["number"].try_cast("decimal(38,18)"))
    sign = F.when(c["negative"], -100).otherwise(100)
    return {"value": (F.round(amount, 2) * sign).try_cast("bigint")}


STEPS: dict[str, list[Step]] = {
    "trim": [_trim_value],
    "parse_date": [_date_text, _date_value],
    "to_int": [_int_value],
    "to_minor_units": [_money_number, _money_value],
}


def _enum_steps(allowed: Sequence[str]) -> list[Step]:
    def value(c: Mapping[str, Column]) -> Mapping[str, Column]:
        """Case-insensitive membership; yields the registered spelling."""
        found = F.lit(None).cast("string")
        for spelling in reversed(allowed):
            found = F.when(F.lower(c["text"]) == spelling.lower(), F.lit(spelling)).otherwise(found)
        return {"value": found}

    return [value]


def _code(function: str, c: Mapping[str, Column]) -> Column:
    failed = c["text"].isNotNull() & c["value"].isNull()
    if function == "parse_date":
        return F.when(failed, F.when(c["iso"].isNull() & c["text"].rlike(SLASH_DATE), AMBIGUOUS).otherwise(COERCION))
    return F.when(failed, BAD_ENUM if function == "map_enum" else COERCION)


def parse_cells(df: DataFrame, cells: Mapping[str, Cell]) -> DataFrame:
    """Add `<name>_raw`, `<name>_value` and `<name>_code` per entry of `cells`."""
    steps: dict[str, list[Step]] = {}
    for name, cell in cells.items():
        if cell.function == "map_enum":
            steps[name] = _enum_steps(cell.enum_values)
        elif cell.function in STEPS:
            steps[name] = STEPS[cell.function]
        else:
            raise KeyError(f"unknown transform {cell.function!r}")

    helper = {name: f"_p{i}" for i, name in enumerate(cells)}
    known: dict[str, dict[str, Column]] = {name: {} for name in cells}
    kept = [F.col(c) for c in df.columns]

    def project(frame: DataFrame, added: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        carried = [known[name][part] for name in cells for part in known[name]]
        new = []
        for name, parts in added.items():
            for part, column in parts.items():
                alias = f"{helper[name]}_{part}"
                new.append(column.alias(alias))
                known[name][part] = F.col(alias)
        return frame.select(*kept, *carried, *new)

    def opening(cell: Cell) -> dict[str, Column]:
        parts = {"cell": cell.raw, "text": strip_to_null(cell.raw)}
        if cell.function == "to_minor_units":
            parts["bare"] = strip(F.translate(cell.raw, CURRENCY_SYMBOLS, ""))
        return parts

    out = project(df, {name: opening(cell) for name, cell in cells.items()})
    for depth in range(max(len(s) for s in steps.values())):
        out = project(
            out, {name: chain[depth](known[name]) for name, chain in steps.items() if depth < len(chain)}
        )
    results = [
        column
        for name, cell in cells.items()
        for column in (
            known[name]["cell"].alias(f"{name}_raw"),
            known[name]["value"].alias(f"{name}_value"),
            _code(cell.function, known[name]).alias(f"{name}_code"),
        )
    ]
    return out.select(*df.columns, *results)
