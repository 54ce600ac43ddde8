"""Landing: immutable raw rows, batches that replay, a ledger of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.hashing import row_hash, set_fingerprint, stable_id


def register_sources(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Get-or-create: the sources table with those of `seen` it lacked.

    Both have (tenant_id, name, kind); ids follow from these, so a retry agrees.
    """
    key = ["tenant_id", "name", "kind"]
    new = seen.select(*key).distinct().join(known, key, "left_anti")
    return known.unionByName(new.select(stable_id(*[F.col(c) for c in key]).alias("id"), *key))


def payload_fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """Content hash per payload from its row hashes and their positions."""
    placed = F.sha2(F.concat_ws("|", F.col("row_index").cast("string"), row_hash(F.col("raw"))), 256)
    return rows.select(*by, placed.alias("_hash")).groupBy(*by).agg(
        set_fingerprint(F.col("_hash")).alias("file_hash"), F.count(F.lit(1)).alias("row_count")
    )


def replay_status(incoming: DataFrame, batches: DataFrame) -> DataFrame:
    """Incoming payloads with their batch and whether it existed already.

    A batch is known by (tenant_id, source_id, file_hash). A replay keeps the
    earlier batch id and must not write; of equal payloads one batch is made.
    """
    key = ["tenant_id", "source_id", "file_hash"]
    earlier = batches.select(*key, F.col("id").alias("_id"))
    return incoming.join(earlier, key, "left").select(
        *incoming.columns,
        F.coalesce("_id", stable_id(*[F.col(c) for c in key])).alias("batch_id"),
        F.col("_id").isNotNull().alias("is_replay"),
    )


def new_batches(status: DataFrame) -> DataFrame:
    """Ledger rows of the payloads not seen before."""
    fresh = status.where(~F.col("is_replay"))
    about = [c for c in ("filename", "encoding", "delimiter", "row_count") if c in status.columns]
    return fresh.groupBy(F.col("batch_id").alias("id"), "tenant_id", "source_id", "file_hash").agg(
        *[F.min(c).alias(c) for c in about], F.lit("queued").alias("status"),
        F.lit(None).cast("int").alias("mapping_spec_version"),
    )


def raw_records(rows: DataFrame) -> DataFrame:
    """Append-only raw rows: identity, cells and the hash of the cells."""
    return rows.select(
        stable_id(F.col("batch_id"), F.col("row_index").cast("string")).alias("id"),
        "tenant_id", "source_id", "batch_id", "row_index", "raw", row_hash(F.col("raw")).alias("content_hash"),
    )


def request_outcomes(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Status of each request: new, replay, or conflict.

    The same (tenant, endpoint, key) with the same fingerprint replays the
    stored result; with another fingerprint it is a conflict. Without a key a
    request always runs.
    """
    key = ["tenant_id", "endpoint", "key"]
    stored = ledger.select(*key, F.col("fingerprint").alias("_was"), F.col("result").alias("_result"))
    keyed = requests.where(F.col("key").isNotNull()).join(stored, key, "left")
    status = (
        F.when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("fingerprint"), "replay").otherwise("conflict")
    )
    decided = keyed.select(*requests.columns, status.alias("status"),
                           F.when(F.col("_was") == F.col("fingerprint"), F.col("_result")).alias("result"))
    free = requests.where(F.col("key").isNull()).select(
        *requests.columns, F.lit("new").alias("status"), F.lit(None).cast("string").alias("result")
    )
    return decided.unionByName(free)
