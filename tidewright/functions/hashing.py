"""Content hashes and deterministic ids (never random: recomputed tasks agree)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(raw: Column) -> Column:
    """sha256 over the row's JSON with sorted keys and explicit nulls."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(raw)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def values_hash(values: Sequence[Column]) -> Column:
    """sha256 over typed values (aliased columns), explicit nulls included."""
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def stable_id(*parts: Column | str) -> Column:
    """sha256 over the parts, each with its length in bytes (`-` for null): no two lists of parts read alike."""
    texts = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def set_fingerprint(hashes: Column, lanes: int = 4) -> Column:
    """Order-free fingerprint of a group of hex sha256 values, as an aggregate.

    Each hash is cut into 60-bit lanes which are summed, so the state is a few
    decimals and partial aggregation works, whatever the size of the group.
    """
    sums = [
        F.sum(F.conv(F.substring(hashes, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(lanes)
    ]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)
