"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 4096
DEALT = 100_000  # rows that one task parses


def use_all_cores(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan evenly to tasks before costly parsing, at least one per core and one per `DEALT` rows.

    Splits say nothing about rows: a file of few row groups has many splits, most of them empty."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // DEALT)), key)


def _all_set(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def key_counts(facts: DataFrame, on: Sequence[str], into: str = "_facts") -> DataFrame:
    """How many fact rows carry each key; counted map-side before the shuffle."""
    return facts.where(_all_set(on)).groupBy(*on).agg(F.count(F.lit(1)).alias(into))


def spread_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """`facts LEFT JOIN lookup`, where `lookup` has one row per key (and perhaps
    `_facts`, their number, which is left out).

    Rows with a null key match nothing; they are spread by `row_id`. A hot key
    makes a large shuffle partition of facts, which adaptive execution splits,
    whatever the number of such keys: its one lookup row goes to each part.
    """
    values = [c for c in lookup.columns if c not in (*on, "_facts")]
    keys = [f"_k{i}" for i in range(len(on))]
    spread = F.when(_all_set(on), 0).otherwise(1 + F.pmod(F.xxhash64(*row_id), F.lit(SPREAD))).cast("bigint")
    left = facts.select("*", *[F.when(_all_set(on), F.col(c)).alias(k) for c, k in zip(on, keys)], spread.alias("_spread"))
    right = lookup.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.lit(0).cast("bigint").alias("_spread"),
                          *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    joined = left.join(right, [*keys, "_spread"], "left")
    return joined.select(*facts.columns, *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])


def spread_nulls(df: DataFrame, key: str, row_id: Sequence[str]) -> DataFrame:
    """Add `_spread`: 0 where the key is set, else spread over many values, so
    that an outer join on (key, _spread) does not send all null keys to one task."""
    return df.withColumn(
        "_spread",
        F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*row_id), F.lit(SPREAD))).otherwise(0).cast("bigint"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last row per key by `order`, as an aggregate (no window over a hot key)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )
