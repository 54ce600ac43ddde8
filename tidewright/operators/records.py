"""Apply a mapping spec to raw rows: typed canonical records plus errors.

A spec is `{canonical field: {source_column, transform: {function, params},
provenance}}`. It is a small document, so it becomes one projection.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.functions.parse import Cell, parse_cells

ERROR = "struct<field:string,code:string,raw_value:string>"
ERRORS = f"array<{ERROR}>"


class InvalidSpec(ValueError):
    """The spec cannot produce loadable records."""


def entry(source_column: str, function: str | None = None, field: str | None = None) -> dict:
    """A spec entry; the parser defaults to the one registered for the field."""
    name = function or registry.field(field or "").transform
    return {"source_column": source_column, "transform": {"function": name, "params": {}}}


def spec_for(columns: Mapping[str, str]) -> dict[str, dict]:
    """Spec from {canonical field: source column} with each field's own parser."""
    return {name: entry(column, field=name) for name, column in columns.items()}


def ordered_fields(spec: Mapping[str, dict]) -> list[registry.CanonicalField]:
    """Fields in the document's key order: by length, then by name."""
    return [registry.field(n) for n in sorted(spec, key=lambda n: (len(n), n))]


def tables_of(spec: Mapping[str, dict]) -> list[str]:
    return list(dict.fromkeys(f.table for f in ordered_fields(spec)))


def require_natural_keys(spec: Mapping[str, dict]) -> None:
    for table in tables_of(spec):
        if table in registry.KEYED_TABLES:
            columns = [f.column for f in ordered_fields(spec) if f.table == table]
            if "natural_key" not in columns:
                raise InvalidSpec(f"the spec feeds {table} without a natural key")


def error(field: Column | str, code: Column | str, raw_value: Column) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_column(field).alias("field"),
        as_column(code).alias("code"),
        raw_value.cast("string").alias("raw_value"),
    )


def error_list(candidates: list[tuple[Column, Column]]) -> Column:
    """Array of the errors whose condition holds, in the given order.

    Concatenated rather than filtered: a lambda would leave generated code and
    evaluate everything below it row by row.
    """
    none = F.array().cast(ERRORS)
    if not candidates:
        return none
    any_error = reduce(or_, [F.coalesce(condition, F.lit(False)) for condition, _ in candidates])
    listed = F.concat(*[F.when(condition, F.array(e)).otherwise(none) for condition, e in candidates])
    return F.when(any_error, listed).otherwise(none)


def hold(df: DataFrame, column: str) -> DataFrame:
    """Keep filters on `column` above the projections that compute it.

    Catalyst pushes a filter through projections by writing their expressions
    out in full, which for a chain of parsers repeats them many times over. It
    does not push through the explode of a one-element array.
    """
    others = [c for c in df.columns if c != column]
    held = df.select(*others, F.explode(F.array(column)).alias(column))
    return held.select(*df.columns)


def apply_spec(raw: DataFrame, spec: Mapping[str, dict]) -> DataFrame:
    """Adds `rec` (a struct per table), `link` (customer key per table), `errors`.

    A required field that is mapped but yields nothing is MISSING_REQUIRED. A
    field the spec does not map is not checked, so older specs keep working.
    """
    fields = ordered_fields(spec)
    tables = tables_of(spec)
    cells = {
        f"_f_{f.name}": Cell(
            spec[f.name]["transform"]["function"], F.col("raw")[spec[f.name]["source_column"]], f.enum_values
        )
        for f in fields
    }
    staged = parse_cells(raw, cells)

    def final_code(f: registry.CanonicalField) -> Column:
        code = F.col(f"_f_{f.name}_code")
        if not f.required:
            return code
        return F.when(F.col(f"_f_{f.name}_value").isNull(), F.coalesce(code, F.lit("MISSING_REQUIRED")))

    def typed(f: registry.CanonicalField) -> Column:
        made = registry.SPARK_TYPE_BY_TRANSFORM[spec[f.name]["transform"]["function"]]
        value = F.col(f"_f_{f.name}_value")
        return value if made == f.spark_type else F.lit(None).cast(f.spark_type)

    found = []
    for table in tables:
        for f in fields:
            if f.table != table:
                continue
            code = final_code(f)
            found.append((code.isNotNull(), error(f.name, code, F.col(f"_f_{f.name}_raw"))))

    records, links = [], []
    for table in tables:
        mine = [f for f in fields if f.table == table]
        values = [typed(f).alias(f.column) for f in sorted(mine, key=lambda f: f.column) if not f.is_link]
        records.append((F.struct(*values) if values else F.struct(F.lit(True).alias("empty"))).alias(table))
        key = next((F.col(f"_f_{f.name}_value") for f in mine if f.is_link), F.lit(None))
        links.append(key.cast("string").alias(table))

    # A parser that does not fit the field's type fails every value it produces.
    misfits = []
    for f in fields:
        made = registry.SPARK_TYPE_BY_TRANSFORM[spec[f.name]["transform"]["function"]]
        if made != f.spark_type and not f.is_link:
            value = F.col(f"_f_{f.name}_value")
            misfits.append((f.table, value.isNotNull(), error(f.column, "SCHEMA_VALIDATION_FAILED", value)))

    by_table = [
        error_list([(c, e) for t, c, e in misfits if t == table]).alias(table) for table in tables
    ]
    return staged.select(
        *raw.columns,
        F.struct(*records).alias("rec"),
        F.struct(*links).alias("link"),
        F.struct(*by_table).alias("misfit"),
        error_list(found).alias("errors"),
    )
