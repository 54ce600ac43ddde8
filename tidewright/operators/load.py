"""Load a batch: check every row, upsert the clean ones, quarantine the rest.

The steps are functions of DataFrames. `upsert` yields the next state of a
table, so it ports to MERGE where the table format has one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.functions.hashing import stable_id, values_hash
from tidewright.functions.text import distinct_codes, explanation
from tidewright.operators.joins import key_counts, latest_per_key, spread_lookup
from tidewright.operators.link import link_customers, suggest_customer_fix
from tidewright.operators.records import apply_spec, hold, ordered_fields, require_natural_keys, tables_of
from tidewright.operators.validate import check_records, flag_duplicates
from tidewright.session import reliable

QUARANTINE_COLUMNS = (
    "id", "tenant_id", "batch_id", "row_index", "raw", "error_codes", "severity", "explanation", "suggested_fix",
    "status",
)


def annotate(
    raw: DataFrame,
    spec: Mapping[str, dict],
    customers: DataFrame,
    as_of: date | Column | None = None,
    detect_duplicates: bool = True,
) -> DataFrame:
    """Raw rows with typed records, the resolved customer and all errors.

    `raw` needs tenant_id, batch_id, row_index and `raw` (map of cells). Cells
    are parsed once: the typed rows are stored, and what looks back at all rows
    (repeated keys, key counts, the batch's own customers) reads a few columns.
    """
    require_natural_keys(spec)
    rows = reliable(check_records(apply_spec(raw, spec), spec, as_of), compiled=True)
    if detect_duplicates:
        rows = flag_duplicates(rows, spec)
    tables = tables_of(spec)
    if "customers" in tables and len(tables) > 1:
        customers = with_own_customers(rows, customers)
    return hold(link_customers(rows, spec, customers), "errors")


def with_own_customers(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Stored customers plus those the batch itself brings in clean rows, so
    that records may link to a customer of the same batch, in any row order."""
    key = F.col("rec.customers.natural_key")
    own = hold(rows, "errors").where(F.size("errors") == 0).select("tenant_id", key.alias("natural_key")).distinct()
    known = customers.select("tenant_id", "natural_key", "id")
    fresh = own.join(known, ["tenant_id", "natural_key"], "left_anti")
    return known.unionByName(
        fresh.withColumn("id", stable_id("customers", F.col("tenant_id"), F.col("natural_key")))
    )


def accepted(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.size("errors") == 0)


def rejected(annotated: DataFrame) -> DataFrame:
    """One error in any of its records rejects the whole row."""
    return annotated.where(F.size("errors") > 0)


def quarantine_rows(annotated: DataFrame, customers: DataFrame) -> DataFrame:
    """Quarantine entries for the rejected rows, with a suggested fix for orphans."""
    bad = rejected(annotated)
    orphan = F.exists("errors", lambda e: e["code"] == "REF_INTEGRITY_ORPHAN_FK")
    bad = bad.withColumn("_orphan_key", F.when(orphan, F.col("link_key")))
    on = ["tenant_id", "_orphan_key"]
    counts = key_counts(bad, on)
    fixes = suggest_customer_fix(counts.withColumnRenamed("_orphan_key", "link_key"), customers)
    fixes = fixes.select("tenant_id", F.col("link_key").alias("_orphan_key"), "suggested_fix").join(counts, on)
    bad = spread_lookup(bad, fixes, on, ["batch_id", "row_index"])
    return bad.select(
        stable_id(F.col("batch_id"), F.col("row_index").cast("string")).alias("id"),
        "tenant_id",
        "batch_id",
        "row_index",
        "raw",
        distinct_codes(F.col("errors")).alias("error_codes"),
        F.lit("error").alias("severity"),
        explanation(F.col("errors")).alias("explanation"),
        "suggested_fix",
        F.lit("open").alias("status"),
    )


def load_summary(annotated: DataFrame, spec_version: int) -> DataFrame:
    clean = F.size("errors") == 0
    return annotated.groupBy("batch_id").agg(
        F.lit(spec_version).alias("mapping_spec_version"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(clean).alias("loaded"),
        F.count_if(~clean).alias("quarantined"),
    )


def mapped_columns(spec: Mapping[str, dict], table: str) -> list[str]:
    return sorted(f.column for f in ordered_fields(spec) if f.table == table and not f.is_link)


def incoming_records(clean: DataFrame, spec: Mapping[str, dict], table: str) -> DataFrame:
    """Clean rows as rows of a canonical table, with the hash of their values.

    The hash leaves out the customer link and the batch, so re-linking an
    otherwise equal record changes nothing.
    """
    columns = mapped_columns(spec, table)
    source = {c: F.col(f"rec.{table}.{c}") for c in columns}
    mirror = registry.MIRROR_OF_NATURAL_KEY.get(table)
    if mirror:
        source[mirror] = source["natural_key"]
    values = [source[c].alias(c) for c in sorted(source)]
    link = [] if table == "customers" else ["customer_id"]
    return clean.select(
        "tenant_id", *link, *values, values_hash(values).alias("content_hash"),
        F.col("batch_id").alias("source_batch_id"), "row_index",
    )


def incoming_accounts(clean: DataFrame, spec: Mapping[str, dict]) -> DataFrame:
    """One row per account number: last values, last customer that is known."""
    columns = mapped_columns(spec, "accounts")
    rows = clean.select(
        "tenant_id", "customer_id", *[F.col(f"rec.accounts.{c}").alias(c) for c in columns],
        F.struct("batch_id", "row_index").alias("row_index"),
    ).where(F.col("account_number").isNotNull())
    rest = [c for c in columns if c != "account_number"]
    last = [F.max_by(c, "row_index").alias(c) for c in rest]
    known = F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), F.col("row_index")))
    return rows.groupBy("tenant_id", "account_number").agg(*last, known.alias("customer_id"))


def upsert_plan(
    current: DataFrame,
    incoming: DataFrame,
    table: str,
    mapped: Sequence[str],
    loaded_at: Column | None = None,
) -> DataFrame:
    """Next state of `table` with `_action`: insert, update, noop or keep.

    Both sides have one row per key, so the full outer join has no skew. A row
    whose hash is unchanged is left alone. Mapped columns are overwritten, nulls
    included; unmapped ones keep their value.
    """
    key = "account_number" if table == "accounts" else "natural_key"
    now = F.current_timestamp() if loaded_at is None else loaded_at
    defaults = {c: F.lit(v) for c, v in registry.COLUMN_DEFAULTS.get(table, {}).items()}
    if table == "customers":
        defaults["created_at"] = now
    schema = registry.table_schema(table)
    written = set(mapped) | {"content_hash", "source_batch_id", registry.MIRROR_OF_NATURAL_KEY.get(table)}
    old = current.select("tenant_id", key, F.struct(*[c for c, _ in schema]).alias("o"))
    new = incoming.select("tenant_id", key, F.struct(*[c for c in incoming.columns if c not in ("tenant_id", key)]).alias("n"))
    both = old.join(new, ["tenant_id", key], "full_outer")
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()
    fresh = has_new & ~has_old
    if table == "accounts":
        # a new account nobody owns is not created
        both = both.where(has_old | F.col("n.customer_id").isNotNull())
        changed = has_old & has_new
    else:
        changed = has_old & has_new & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash"))
    action = (
        F.when(fresh, "insert").when(changed, "update").when(has_old & has_new, "noop").otherwise("keep")
    )
    columns = []
    for name, kind in schema:
        before = F.col(f"o.{name}")
        if name in ("tenant_id", key):
            columns.append(F.col(name))
            continue
        if name == "id":
            value = F.when(fresh, stable_id(table, F.col("tenant_id"), F.col(key))).otherwise(before)
        elif name == "updated_at":
            value = F.when(fresh | changed, now).otherwise(before)
        elif name == "customer_id":
            after = F.coalesce(F.col("n.customer_id"), before) if table == "accounts" else F.col("n.customer_id")
            value = F.when(fresh | changed, after).otherwise(before)
        elif name in written:
            after = F.col(f"n.{name}")
            if name in defaults:
                after = F.coalesce(after.cast(kind), defaults[name])
            value = F.when(fresh | changed, after.cast(kind)).otherwise(before)
        else:
            value = F.when(fresh, defaults.get(name, F.lit(None)).cast(kind)).otherwise(before)
        columns.append(value.cast(kind).alias(name))
    return both.select(*columns, action.alias("_action"))


def upsert(
    current: DataFrame, incoming: DataFrame, table: str, mapped: Sequence[str], loaded_at: Column | None = None
) -> DataFrame:
    return upsert_plan(current, incoming, table, mapped, loaded_at).drop("_action")


def empty_table(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in registry.table_schema(table)))


def next_tables(
    annotated: DataFrame,
    spec: Mapping[str, dict],
    current: Mapping[str, DataFrame],
    loaded_at: Column | None = None,
    last_wins: bool = False,
) -> dict[str, DataFrame]:
    """Next state of every canonical table the spec feeds.

    With `last_wins` clean rows may repeat a key (reprocessed rows do): the last
    row of each key counts, for each table on its own.
    """
    clean = accepted(annotated)
    out = {}
    for table in tables_of(spec):
        if table == "accounts":
            incoming = incoming_accounts(clean, spec)
        else:
            incoming = incoming_records(clean, spec, table)
            if last_wins:
                place = F.struct("source_batch_id", "row_index")
                incoming = latest_per_key(incoming.withColumn("_place", place), ["tenant_id", "natural_key"], F.col("_place")).drop("_place")
            incoming = incoming.drop("row_index")
        out[table] = upsert(current[table], incoming, table, mapped_columns(spec, table), loaded_at)
    return out


def add_column(table: DataFrame, name: str, kind: str, backfill: Column) -> DataFrame:
    """Schema evolution: add a column, or fill the nulls of one that exists."""
    value = F.coalesce(F.col(name), backfill) if name in table.columns else backfill
    return table.withColumn(name, value.cast(kind))


def append_evolved(old: DataFrame, new: DataFrame, backfills: Mapping[str, Column]) -> DataFrame:
    """Union of two generations of a table; columns either side lacks are filled."""
    merged = old.unionByName(new, allowMissingColumns=True)
    return merged.withColumns({c: F.coalesce(F.col(c), v) for c, v in backfills.items()})
