"""Checks on built records: business rules, types, duplicates inside a batch."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.operators.records import ERRORS, error, error_list, ordered_fields, tables_of


def business_rules(record: Column, columns: list[str], as_of: Column) -> Column:
    """Invoice rules; only those whose columns the spec maps."""
    rules = []
    if "issue_date" in columns:
        issued = record["issue_date"]
        rules.append((issued > as_of, error("issue_date", "BUSINESS_RULE_FUTURE_DATE", issued)))
    if "amount_minor_units" in columns:
        amount = record["amount_minor_units"]
        rules.append((amount < 0, error("amount_minor_units", "BUSINESS_RULE_NEGATIVE_AMOUNT", amount)))
    if "issue_date" in columns and "due_date" in columns:
        due = record["due_date"]
        rules.append((due < record["issue_date"], error("due_date", "BUSINESS_RULE_DUE_BEFORE_ISSUE", due)))
    return error_list(rules)


def check_records(built: DataFrame, spec: Mapping[str, dict], as_of: date | Column | None = None) -> DataFrame:
    """Append business-rule and type errors, table by table, to `errors`."""
    today = F.current_date() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    lists = [F.col("errors")]
    for table in tables_of(spec):
        columns = [f.column for f in ordered_fields(spec) if f.table == table]
        if table == "invoices":
            lists.append(business_rules(F.col("rec.invoices"), columns, today))
        lists.append(F.col(f"misfit.{table}"))
    return built.withColumn("errors", F.concat(*lists)).drop("misfit")


def flag_duplicates(checked: DataFrame, spec: Mapping[str, dict]) -> DataFrame:
    """DUPLICATE_EXACT on every repeat of a natural key inside its batch.

    Rows with other errors count as the first occurrence too. The first row of
    each key comes from an aggregate; rows then look themselves up by key *and*
    row index, so a key that fills a third of the batch is spread evenly.
    """
    out = checked
    for table in tables_of(spec):
        columns = [f.column for f in ordered_fields(spec) if f.table == table]
        if table not in registry.KEYED_TABLES or "natural_key" not in columns:
            continue
        keyed = out.withColumn("_key", F.col(f"rec.{table}.natural_key"))
        first = (
            keyed.where(F.col("_key").isNotNull())
            .groupBy("batch_id", "_key")
            .agg(F.min("row_index").alias("row_index"))
            .withColumn("_first", F.lit(True))
        )
        repeat = F.col("_key").isNotNull() & F.col("_first").isNull()
        duplicate = F.when(repeat, F.array(error("natural_key", "DUPLICATE_EXACT", F.col("_key"))))
        out = keyed.join(first, ["batch_id", "row_index", "_key"], "left").select(
            *[c for c in checked.columns if c != "errors"],
            F.concat("errors", F.coalesce(duplicate, F.array().cast(ERRORS))).alias("errors"),
        )
    return out.select(*checked.columns)
