"""Triage of quarantined rows: list, ignore, correct and reprocess, group."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.load import QUARANTINE_COLUMNS, accepted, annotate, quarantine_rows


def list_quarantine(
    quarantine: DataFrame, tenant_id: str, batch_id: str | None = None, status: str | None = "open"
) -> DataFrame:
    """Entries of a tenant; partition and status filters reach the scan."""
    out = quarantine.where(F.col("tenant_id") == tenant_id)
    if batch_id is not None:
        out = out.where(F.col("batch_id") == batch_id)
    return out if status is None else out.where(F.col("status") == status)


def error_groups(quarantine: DataFrame) -> DataFrame:
    """Number of entries per error code, most frequent first."""
    return (
        quarantine.select(F.explode("error_codes").alias("error_code"))
        .groupBy("error_code")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "error_code")
    )


def patched(raw: Column, corrections: Mapping[str, str | None]) -> Column:
    """The raw row with the corrected cells laid over it."""
    if not corrections:
        return raw
    names = [F.lit(k) for k in corrections]
    cells = [F.lit(v).cast("string") for v in corrections.values()]
    kept = F.map_filter(raw, lambda k, v: ~k.isin(*corrections))
    return F.map_concat(kept, F.map_from_arrays(F.array(*names), F.array(*cells)))


def ignore(quarantine: DataFrame, chosen: Column) -> DataFrame:
    return quarantine.withColumn("status", F.when(chosen, "ignored").otherwise(F.col("status")))


def reprocess(
    chosen: DataFrame,
    spec: Mapping[str, dict] | None,
    customers: DataFrame,
    corrections: Mapping[str, str | None],
    as_of: date | Column | None = None,
) -> DataFrame:
    """Corrected rows of one source, checked again in one set-based run.

    Each row stands alone: a natural key that other corrected rows share is not
    a duplicate here, the last row wins on loading (`next_tables` with `last_wins`). Without a
    confirmed spec nothing is attempted and the result is empty.
    """
    if spec is None:
        return chosen.where(F.lit(False)).select("tenant_id", "batch_id", "row_index", "raw")
    rows = chosen.select("tenant_id", "batch_id", "row_index", patched(F.col("raw"), corrections).alias("raw"))
    return annotate(rows, spec, customers, as_of, detect_duplicates=False)


def resolved_quarantine(quarantine: DataFrame, again: DataFrame, customers: DataFrame) -> DataFrame:
    """Quarantine after a reprocessing run: loaded entries become resubmitted,
    the others stay open with the corrected cells and their new errors."""
    loaded = accepted(again).select(
        "batch_id", "row_index", F.lit("resubmitted").alias("_status"), F.lit(None).alias("_entry")
    )
    fresh = quarantine_rows(again, customers)
    carried = ("raw", "error_codes", "explanation", "suggested_fix")
    still = fresh.select("batch_id", "row_index", F.lit("open").alias("_status"), F.struct(*carried).alias("_entry"))
    outcome = loaded.withColumn("_entry", F.lit(None).cast(still.schema["_entry"].dataType)).unionByName(still)
    joined = quarantine.join(outcome, ["batch_id", "row_index"], "left")
    replaced = {
        c: F.when(F.col("_entry").isNotNull(), F.col(f"_entry.{c}")).otherwise(F.col(c)) for c in carried
    }
    return joined.withColumns(replaced).withColumn("status", F.coalesce("_status", "status")).select(*QUARANTINE_COLUMNS)


def bulk_counts(after: DataFrame, chosen: DataFrame) -> DataFrame:
    """processed / loaded / still_open of the entries a bulk action chose."""
    return (
        chosen.select("batch_id", "row_index")
        .join(after.select("batch_id", "row_index", "status"), ["batch_id", "row_index"])
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("status") == "resubmitted").alias("loaded"),
            F.count_if(F.col("status") == "open").alias("still_open"),
        )
    )


def with_code(quarantine: DataFrame, tenant_id: str, error_code: str) -> DataFrame:
    """Open entries of a tenant that carry an error code."""
    return list_quarantine(quarantine, tenant_id).where(F.array_contains("error_codes", error_code))
