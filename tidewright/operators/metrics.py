"""Tenant dashboards: counts over the state tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric name -> (table, status that counts)
METRICS = {
    "batches": ("batches", None),
    "customers": ("customers", None),
    "invoices": ("invoices", None),
    "support_tickets": ("support_tickets", None),
    "accounts": ("accounts", None),
    "quarantine_open": ("quarantine", "open"),
    "quarantine_fixed": ("quarantine", "resubmitted"),
    "mapping_specs_confirmed": ("mapping_specs", "confirmed"),
}


def tenant_metrics(tables: Mapping[str, DataFrame], tenants: DataFrame | None = None) -> DataFrame:
    """One row per tenant; tenants asked for (`tenant_id`) without data get zeros.

    Each table is counted once, map-side, before the small counts are combined.
    """
    parts = []
    for table in dict.fromkeys(t for t, _ in METRICS.values()):
        if table not in tables:
            continue
        names = {m: status for m, (t, status) in METRICS.items() if t == table}
        counts = tables[table].groupBy("tenant_id").agg(
            *[(F.count(F.lit(1)) if s is None else F.count_if(F.col("status") == s)).alias(m) for m, s in names.items()]
        )
        parts.append(counts)
    if tenants is not None:
        parts.append(tenants.select("tenant_id").distinct())
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    for m in METRICS:
        if m not in merged.columns:
            merged = merged.withColumn(m, F.lit(None).cast("bigint"))
    return merged.groupBy("tenant_id").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRICS])
