"""The stages of an onboarding run over stored state.

Each function reads state tables, runs one stage, and writes the next state.
A stage that is run again after a failure, or on purpose, changes nothing more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.operators import dedupe, landing, load, mapping, metrics, profile, quarantine
from tidewright.operators.records import tables_of
from tidewright.session import reliable
from tidewright.sources import delimited, pages
from tidewright.sources.state import State

SOURCES = "id string, tenant_id string, name string, kind string"
BATCHES = (
    "id string, tenant_id string, source_id string, file_hash string, filename string, encoding string, "
    "delimiter string, row_count bigint, status string, mapping_spec_version int"
)
RAW = "id string, tenant_id string, source_id string, batch_id string, row_index bigint, raw map<string,string>, content_hash string"
SPECS = (
    "id string, tenant_id string, source_id string, version int, "
    f"spec map<string,{mapping.ENTRY}>, status string, parent_version int"
)
QUARANTINE = (
    "id string, tenant_id string, batch_id string, row_index bigint, raw map<string,string>, error_codes array<string>, "
    "severity string, explanation string, suggested_fix string, status string"
)
CANDIDATES = (
    "id string, tenant_id string, customer_id_a string, customer_id_b string, match_probability double, status string"
)


REQUESTS = "tenant_id string, endpoint string, key string, fingerprint string, result string"
CANONICAL = ("customers", "accounts", "invoices", "support_tickets")


class UnknownBatch(LookupError):
    """No such batch."""


class RequestConflict(ValueError):
    """The key was used before, for something else."""


class NoConfirmedSpec(ValueError):
    """The batch's source has no confirmed mapping spec."""


class Workspace:
    """The state tables of an installation, below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        schemas = {"sources": SOURCES, "batches": BATCHES, "mapping_specs": SPECS, "quarantine": QUARANTINE,
                   "duplicate_candidates": CANDIDATES, "requests": REQUESTS}
        for t in CANONICAL:
            schemas[t] = ", ".join(f"{c} {k}" for c, k in registry.table_schema(t))
        self.state = State(spark, self.root, schemas)

    def read(self, table: str, tenants: Sequence[str] | str | None = None) -> DataFrame:
        return self.state.read(table, tenants)

    def commit(self, tables: Mapping[str, DataFrame], tenants: Sequence[str] | str | None = None) -> None:
        """Replace the rows of some tenants in some tables, all in one step."""
        self.state.commit(tables, [tenants] if isinstance(tenants, str) else tenants)

    def write(self, table: str, df: DataFrame, tenants: Sequence[str] | str | None = None) -> DataFrame:
        self.commit({table: df}, tenants)
        return self.read(table, tenants)

    def batch(self, batch_id: str) -> Row:
        """The ledger row of a batch."""
        row = self.read("batches").where(F.col("id") == batch_id).first()
        if row is None:
            raise UnknownBatch(batch_id)
        return row

    # raw rows and profiles are append-only: one folder per tenant and batch
    def raw(self, batch_id: str | None = None, tenant_id: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(RAW).parquet(f"{self.root}/raw_records")
        for column, value in (("batch_id", batch_id), ("tenant_id", tenant_id)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows

    def replace_batches(self, name: str, df: DataFrame) -> None:
        """Write df's batches, replacing only the folders of these batches."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("tenant_id", "batch_id").parquet(f"{self.root}/{name}"))


def once(ws: Workspace, tenant_id: str, endpoint: str, key: str | None, fingerprint: str, stage: Callable[[], Any]) -> tuple[str, Any]:
    """Run a stage at most once per (tenant, endpoint, key); returns (new or replay, its JSON result).

    The outcome is committed together with all the stage's tables: a stage that breaks off leaves neither, and the same
    key runs it again. A finished key replays its result; with another fingerprint it is refused. Without a key the
    stage always runs.
    """
    form = "tenant_id string, endpoint string, key string, fingerprint string"
    asked = ws.spark.createDataFrame([(tenant_id, endpoint, key, fingerprint)], form)
    known = landing.request_outcomes(asked, ws.read("requests", tenant_id)).first()
    if known["status"] == "conflict":
        raise RequestConflict(f"{endpoint}: key {key} was used for another request")
    if known["status"] == "replay":
        return "replay", json.loads(known["result"])
    with ws.state.transaction():
        result = stage()
        if key is not None:
            ledger = ws.read("requests", tenant_id)
            row = asked.withColumn("result", F.lit(json.dumps(result)))
            ws.commit({"requests": ledger.unionByName(row.select(*ledger.columns))}, tenant_id)
    return "new", result


def land_rows(ws: Workspace, rows: DataFrame, files: DataFrame, tenant_id: str, source_name: str, kind: str) -> DataFrame:
    """Land raw rows (path, row_index, raw) of files (path, file_hash, ...).

    Returns one row per file: path, batch_id, is_replay. Files whose content the
    source delivered before are not landed again.
    """
    spark = ws.spark
    seen = spark.createDataFrame([(tenant_id, source_name, kind)], "tenant_id string, name string, kind string")
    sources = reliable(landing.register_sources(ws.read("sources", tenant_id), seen))
    source_id = sources.where((F.col("name") == source_name) & (F.col("kind") == kind)).first()["id"]
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("row_count"))
    incoming = files.join(counts, "path", "left").select(
        "path", F.lit(tenant_id).alias("tenant_id"), F.lit(source_id).alias("source_id"), "file_hash",
        F.element_at(F.split("path", "/"), -1).alias("filename"), "encoding", "delimiter",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )
    batches = ws.read("batches", tenant_id)
    status = reliable(landing.replay_status(incoming, batches))
    # of files with equal content in one delivery, the first path is landed
    first = status.where(~F.col("is_replay")).groupBy("batch_id").agg(F.min("path").alias("path"))
    landed = rows.join(first, "path").select(
        F.lit(tenant_id).alias("tenant_id"), F.lit(source_id).alias("source_id"), "batch_id", "row_index", "raw"
    )
    if not status.where(~F.col("is_replay")).isEmpty():
        ws.replace_batches("raw_records", landing.raw_records(landed))
        fresh = landing.new_batches(status).select(*batches.columns)
        ws.commit({"sources": sources, "batches": batches.unionByName(fresh)}, tenant_id)
    return status.select("path", "batch_id", "is_replay")


def land_folder(ws: Workspace, folder: str, tenant_id: str, source_name: str, kind: str) -> DataFrame:
    """Land every delimited file of a drop folder, one batch per file.

    A file of any size is known by the hashes of its rows and their places,
    which add up across tasks. A file that has a header only is a batch of no rows.
    """
    some = delimited.read_ranges(ws.spark, folder)
    rows = reliable(delimited.with_row_index(reliable(delimited.read_rows(some, folder))))
    by_rows = landing.payload_fingerprints(rows, ["path"]).select("path", "file_hash")
    # a file without rows is known by its header
    empty = F.sha2(F.to_json("header"), 256)
    files = some.select("path", "encoding", "delimiter").distinct().join(delimited.read_headers(some, folder), "path").join(by_rows, "path", "left")
    files = reliable(files.select("path", "encoding", "delimiter", F.coalesce("file_hash", empty).alias("file_hash")))
    return land_rows(ws, rows, files, tenant_id, source_name, kind)


def land_pull(ws: Workspace, folder: str, tenant_id: str, source_name: str, kind: str = "crm", filename: str = "pull.json") -> DataFrame:
    """Land the pages of a complete API pull as one batch; a pull that lacks pages or has no items is refused."""
    rows = reliable(pages.read_pull(ws.spark, folder).select(F.lit(filename).alias("path"), "row_index", "raw"))
    if rows.isEmpty():
        raise ValueError(f"the pull in {folder} has no items")
    return land_pages(ws, rows, tenant_id, source_name, kind)


def land_pages(ws: Workspace, rows: DataFrame, tenant_id: str, source_name: str, kind: str) -> DataFrame:
    """Land items (path, row_index, raw), one batch per path."""
    files = landing.payload_fingerprints(rows, ["path"]).select(
        "path", "file_hash", F.lit("UTF-8").alias("encoding"), F.lit(None).cast("string").alias("delimiter"))
    return land_rows(ws, rows, files, tenant_id, source_name, kind)


def profile_batch(ws: Workspace, batch_id: str, tenant_id: str) -> DataFrame:
    """Profile a landed batch; a second run replaces the first one's rows."""
    raw = ws.raw(batch_id)
    kinds = ws.read("sources", tenant_id).select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    batch = ws.read("batches", tenant_id).where(F.col("id") == batch_id).select(F.col("id").alias("batch_id"), "source_id").join(kinds, "source_id")
    profiles = reliable(profile.profile_raw(raw).join(batch.drop("source_id"), "batch_id").withColumn("tenant_id", F.lit(tenant_id)))
    ws.replace_batches("column_profiles", profiles)
    return profiles


def propose_spec(ws: Workspace, batch_id: str, tenant_id: str, decisions: DataFrame | None = None) -> str:
    """Score a batch's columns and store a new draft spec; returns its id."""
    by = ["batch_id"]
    profiles = profile_batch(ws, batch_id, tenant_id)
    mapped = mapping.column_mappings(mapping.score_columns(profiles, by), by).join(
        profiles.select(*by, "column_name", "source_kind"), [*by, "column_name"])
    if decisions is None:
        decisions = ws.spark.createDataFrame(
            [], "batch_id string, column_name string, field string, model string, confidence double, reasoning string")
    documents = mapping.spec_documents(mapping.spec_entries(mapped, decisions, by), by)
    batch = ws.read("batches", tenant_id).select(F.col("id").alias("batch_id"), "tenant_id", "source_id")
    drafts = documents.join(batch, "batch_id").select("tenant_id", "source_id", "spec")
    specs = ws.read("mapping_specs", tenant_id)
    new = reliable(mapping.next_versions(specs, drafts))
    ws.write("mapping_specs", specs.unionByName(new.select(*specs.columns)), tenant_id)
    return new.first()["id"]


def override_spec(ws: Workspace, spec_id: str, patch: Mapping[str, Mapping | None]) -> Row:
    """Lay entries ({field: {source_column, ...} or None}) over a draft spec, in place; returns its row."""
    tenant_id = spec_row(ws, spec_id)["tenant_id"]
    specs = ws.read("mapping_specs", tenant_id)
    entries = [(name, e and (e["source_column"], e.get("transform") and (e["transform"]["function"], dict(e["transform"].get("params") or {})), None))
               for name, e in patch.items()]
    override = ws.spark.createDataFrame([(spec_id, dict(entries))], f"id string, patch map<string,{mapping.ENTRY}>")
    after = reliable(mapping.patch_specs(specs, override))
    if after.where(F.col("id") == spec_id).first()["_patch"] != "patched":
        raise ValueError(f"spec {spec_id} is not a draft")
    ws.write("mapping_specs", after.select(*specs.columns), tenant_id)
    return spec_row(ws, spec_id)


def spec_row(ws: Workspace, spec_id: str) -> Row:
    row = ws.read("mapping_specs").where(F.col("id") == spec_id).first()
    if row is None:
        raise ValueError(f"no spec {spec_id}")
    return row


def confirm(ws: Workspace, spec_id: str) -> None:
    tenant_id = spec_row(ws, spec_id)["tenant_id"]
    specs = ws.read("mapping_specs", tenant_id)
    after = reliable(mapping.confirm_specs(specs, ws.spark.createDataFrame([(spec_id,)], "id string")))
    if after.where(F.col("id") == spec_id).first()["_confirm"] != "confirmed":
        raise ValueError(f"spec {spec_id} is not a draft")
    ws.write("mapping_specs", after.select(*specs.columns), tenant_id)


def confirmed_spec(ws: Workspace, batch_id: str) -> tuple[dict, int]:
    try:
        batch = ws.batch(batch_id)
    except UnknownBatch:
        raise NoConfirmedSpec(f"no batch {batch_id}") from None
    specs = mapping.confirmed_specs(ws.read("mapping_specs", batch["tenant_id"]))
    row = specs.where(F.col("source_id") == batch["source_id"]).first()
    if row is None:
        raise NoConfirmedSpec(f"no confirmed mapping spec for the source of batch {batch_id}")
    return mapping.as_document({k: v.asDict(True) for k, v in row["spec"].items()}), row["version"]


def _loaded(
    ws: Workspace, tenant_id: str, annotated: DataFrame, spec: Mapping, loaded_at: Column | None, last_wins: bool = False
) -> dict[str, DataFrame]:
    """The tenant's canonical tables after the clean rows are loaded."""
    current = {t: ws.read(t, tenant_id) for t in tables_of(spec)}
    return load.next_tables(annotated, spec, current, loaded_at, last_wins)


def load_batch(
    ws: Workspace, batch_id: str, as_of: date | None = None, loaded_at: Column | None = None
) -> DataFrame:
    """Load a batch under its source's confirmed spec; returns the summary.

    The annotated rows are written once; tables, quarantine and summary read
    them. Only the batch's tenant is read and written, in one commit. The
    batch's earlier quarantine is replaced.
    """
    spec, version = confirmed_spec(ws, batch_id)
    tenant_id = ws.batch(batch_id)["tenant_id"]
    customers = ws.read("customers", tenant_id)
    rows = reliable(load.annotate(ws.raw(batch_id, tenant_id), spec, customers, as_of))
    entries = load.quarantine_rows(rows, customers)
    others = ws.read("quarantine", tenant_id).where(F.col("batch_id") != batch_id)
    batches = ws.read("batches", tenant_id)
    stamped = F.when(F.col("id") == batch_id, F.lit(version)).otherwise(F.col("mapping_spec_version"))
    ws.commit({
        **_loaded(ws, tenant_id, rows, spec, loaded_at),
        "quarantine": others.unionByName(entries.select(*others.columns)),
        "batches": batches.withColumn("mapping_spec_version", stamped),
    }, tenant_id)
    return load.load_summary(rows, version)


def bulk_fix(
    ws: Workspace, tenant_id: str, error_code: str, corrections: Mapping[str, str | None], as_of: date | None = None,
    loaded_at: Column | None = None, only: Callable[[DataFrame], DataFrame] = lambda entries: entries,
) -> DataFrame:
    """Correct and reload the open entries with a code; returns the counts.

    One set-based run per source. Entries whose source has no confirmed spec
    count as processed and stay open. `only` narrows the choice (single entries).
    """
    chosen = reliable(only(quarantine.with_code(ws.read("quarantine", tenant_id), tenant_id, error_code)))
    _reprocess(ws, tenant_id, chosen, corrections, as_of, loaded_at)
    return quarantine.bulk_counts(ws.read("quarantine", tenant_id), chosen)


def _entry(ws: Workspace, tenant_id: str, entry_id: str) -> DataFrame:
    chosen = reliable(ws.read("quarantine", tenant_id).where(F.col("id") == entry_id))
    if chosen.isEmpty():
        raise LookupError(f"no quarantine entry {entry_id}")
    return chosen


def _ignore(ws: Workspace, tenant_id: str, chosen: DataFrame) -> int:
    entries = ws.read("quarantine", tenant_id)
    mine = chosen.select("id").withColumn("_chosen", F.lit(True))
    marked = quarantine.ignore(entries.join(mine, "id", "left"), F.coalesce("_chosen", F.lit(False)))
    ws.write("quarantine", marked.select(*entries.columns), tenant_id)
    return chosen.count()


def ignore_entry(ws: Workspace, tenant_id: str, entry_id: str) -> None:
    """Set one entry aside."""
    _ignore(ws, tenant_id, _entry(ws, tenant_id, entry_id))


def bulk_ignore(ws: Workspace, tenant_id: str, error_code: str) -> int:
    """Set all open entries with a code aside; returns their number."""
    return _ignore(ws, tenant_id, reliable(quarantine.with_code(ws.read("quarantine", tenant_id), tenant_id, error_code)))


def resolve_entry(
    ws: Workspace, tenant_id: str, entry_id: str, corrections: Mapping[str, str | None], as_of: date | None = None, loaded_at: Column | None = None
) -> Row:
    """Correct and reload one entry; returns its row, resubmitted or still open with its new errors."""
    chosen = _entry(ws, tenant_id, entry_id)
    confirmed_spec(ws, chosen.first()["batch_id"])  # refused without one
    _reprocess(ws, tenant_id, chosen, corrections, as_of, loaded_at)
    return _entry(ws, tenant_id, entry_id).first()


def _reprocess(
    ws: Workspace, tenant_id: str, chosen: DataFrame, corrections: Mapping[str, str | None], as_of: date | None, loaded_at: Column | None
) -> None:
    """Check corrected entries again, source by source, each in one commit."""
    with_source = chosen.join(ws.read("batches", tenant_id).select(F.col("id").alias("batch_id"), "source_id"), "batch_id")
    for source in with_source.select("source_id").distinct().toLocalIterator():
        mine = with_source.where(F.col("source_id") == source["source_id"]).drop("source_id")
        try:
            spec, _ = confirmed_spec(ws, mine.first()["batch_id"])
        except NoConfirmedSpec:
            continue
        customers = ws.read("customers", tenant_id)
        again = reliable(quarantine.reprocess(mine, spec, customers, corrections, as_of))
        ws.commit({
            **_loaded(ws, tenant_id, again, spec, loaded_at, last_wins=True),
            "quarantine": quarantine.resolved_quarantine(ws.read("quarantine", tenant_id), again, customers),
        }, tenant_id)


def find_duplicates(ws: Workspace, threshold: float = 0.5, blank_is_null: bool = False, tenant_id: str | None = None) -> DataFrame:
    """Refresh the duplicate candidates, of one tenant or of all; returns found and new counts."""
    found = dedupe.duplicate_candidates(ws.read("customers", tenant_id), threshold, blank_is_null)
    table = ws.read("duplicate_candidates", tenant_id)
    after = reliable(dedupe.upsert_candidates(table, reliable(found)))
    ws.write("duplicate_candidates", after.select(*table.columns), tenant_id)
    return after.agg(F.count_if("_found").alias("candidates"), F.count_if("_new").alias("new"))


def merge(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """Merge chosen pairs together; returns (tenant_id, loser, winner)."""
    pairs = reliable(pairs)
    tenants = [r["tenant_id"] for r in pairs.select("tenant_id").distinct().collect()]  # of the pairs someone chose
    customers = ws.read("customers", tenants)
    if not dedupe.conflicting_merges(pairs, customers).isEmpty():
        raise ValueError("a customer of a chosen pair no longer exists")
    merges = reliable(dedupe.merge_map(pairs))
    ws.commit({
        **{t: dedupe.repoint(ws.read(t, tenants), merges) for t in ("invoices", "support_tickets", "accounts")},
        "customers": dedupe.drop_merged(customers, merges),
        "duplicate_candidates": dedupe.mark_merged(ws.read("duplicate_candidates", tenants), pairs),
    }, tenants)
    return merges


def list_duplicates(ws: Workspace, tenant_id: str, status: str | None = "open") -> DataFrame:
    return dedupe.list_candidates(ws.read("duplicate_candidates", tenant_id), tenant_id, status)


def dismiss(ws: Workspace, tenant_id: str, candidate_ids: Sequence[str]) -> None:
    """Mark candidate pairs as no duplicates."""
    table = ws.read("duplicate_candidates", tenant_id)
    known = table.where(F.col("id").isin(list(candidate_ids))).count()
    if known != len(set(candidate_ids)):
        raise LookupError("no such duplicate candidate")
    ws.write("duplicate_candidates", dedupe.dismiss(table, F.col("id").isin(list(candidate_ids))), tenant_id)


def tenant_metrics(ws: Workspace, tenants: Sequence[str] | None = None) -> DataFrame:
    """Counts of all state tables per tenant; tenants asked for without data have zeros."""
    asked = None if tenants is None else ws.spark.createDataFrame([(t,) for t in tenants], "tenant_id string")
    tables = {t: ws.read(t, tenants) for t, _ in metrics.METRICS.values()}
    return metrics.tenant_metrics(tables, asked)


def report(ws: Workspace, batch_id: str) -> dict[str, DataFrame]:
    """Report tables of a landed batch: overview, value counts, top values and histograms of its columns."""
    raw = ws.raw(batch_id, ws.batch(batch_id)["tenant_id"])
    return {"profile": profile.profile_raw(raw), "values": profile.value_counts(profile.cells_of_raw(raw))}
