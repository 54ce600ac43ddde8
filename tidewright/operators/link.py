"""Resolve the customer a record belongs to.

Order of attempts: the exact natural key, then the key's digits. Keys that
still miss are orphans; the closest existing key is offered as a fix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.functions.similarity import indel_ratio_udf
from tidewright.functions.text import digits_key
from tidewright.operators.joins import key_counts, spread_lookup, spread_nulls
from tidewright.operators.records import ERRORS, error, tables_of

SUGGEST_AT = 85
SHORT_KEY = 15
LONG_KEY_REMOVALS = 2


def effective_key(spec: Mapping[str, dict]) -> Column:
    """The customer key a row goes by: a record's own before the account's."""
    linked = [t for t in tables_of(spec) if t in registry.LINKED_TABLES]
    order = [t for t in linked if t != "accounts"] + [t for t in linked if t == "accounts"]
    return F.coalesce(*[F.col(f"link.{t}") for t in order]) if order else F.lit(None).cast("string")


def resolve_keys(keys: DataFrame, customers: DataFrame) -> DataFrame:
    """Add `customer_id` and `match` (exact / digits / null) to distinct keys.

    `keys` has one row per (tenant_id, link_key). Among customers whose digits
    agree, the smallest natural key wins.
    """
    exact = customers.select("tenant_id", F.col("natural_key").alias("link_key"), F.col("id").alias("_exact"))
    by_digits = (
        customers.select("tenant_id", digits_key(F.col("natural_key")).alias("_digits"), "natural_key", "id")
        .where(F.col("_digits").isNotNull())
        .groupBy("tenant_id", "_digits")
        .agg(F.min_by("id", "natural_key").alias("_by_digits"))
        .withColumn("_spread", F.lit(0).cast("bigint"))
    )
    matched = keys.join(exact, ["tenant_id", "link_key"], "left").withColumn(
        "_digits", F.when(F.col("_exact").isNull(), digits_key(F.col("link_key")))
    )
    matched = spread_nulls(matched, "_digits", ["link_key"]).join(
        by_digits, ["tenant_id", "_digits", "_spread"], "left"
    )
    return matched.select(
        *keys.columns,
        F.coalesce("_exact", "_by_digits").alias("customer_id"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_by_digits").isNotNull(), "digits").alias("match"),
    )


def link_customers(
    rows: DataFrame, spec: Mapping[str, dict], customers: DataFrame
) -> DataFrame:
    """Add `link_key` and `customer_id`; unresolved keys are REF_INTEGRITY_ORPHAN_FK.

    Keys are made distinct before they meet the customers, so the work grows
    with the number of keys; the answer goes back to the rows by `spread_lookup`.
    """
    keyed = rows.withColumn("link_key", effective_key(spec))
    if not any(t in registry.LINKED_TABLES for t in tables_of(spec)):
        return keyed.withColumn("customer_id", F.lit(None).cast("string"))
    on = ["tenant_id", "link_key"]
    answers = resolve_keys(key_counts(keyed, on), customers).drop("match")
    linked = spread_lookup(keyed, answers, on, ["batch_id", "row_index"])
    orphan = F.col("link_key").isNotNull() & F.col("customer_id").isNull()
    found = F.when(orphan, F.array(error("customer_id", "REF_INTEGRITY_ORPHAN_FK", F.col("link_key"))))
    return linked.withColumn("errors", F.concat("errors", F.coalesce(found, F.array().cast(ERRORS))))


def _shorter_by_one(texts: Column) -> Column:
    drop = lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t)),
        lambda p: F.concat(F.substring(t, F.lit(1), p - 1), t.substr(p + 1, F.length(t))),
    )
    return F.array_distinct(F.flatten(F.transform(texts, drop)))


def _subsequences(df: DataFrame, key: str) -> DataFrame:
    """Rows (..., part): the key with a few of its characters removed.

    Keys that score at least 85 share a part at least 85/115 the length of
    either. Up to 15 characters every such part is listed (three removals at
    most); of longer keys those with up to two characters removed.
    """
    needed = F.floor(F.length(key) * (200 - 2 * SUGGEST_AT) / (200 - SUGGEST_AT)).cast("int")
    depth = F.when(F.length(key) <= SHORT_KEY, needed).otherwise(LONG_KEY_REMOVALS)
    most = SHORT_KEY * (200 - 2 * SUGGEST_AT) // (200 - SUGGEST_AT)
    levels = df.withColumn("_level", F.array(key)).withColumn("_all", F.array(key))
    for i in range(1, most + 1):
        levels = levels.withColumn(
            "_level", F.when(depth >= i, _shorter_by_one(F.col("_level"))).otherwise(F.array().cast("array<string>"))
        ).withColumn("_all", F.concat("_all", "_level"))
    return levels.select(*df.columns, F.explode("_all").alias("part"))


def _nearest_by_parts(orphans: DataFrame, customers: DataFrame) -> DataFrame:
    """Best match by an equi-join on shared parts.

    The score is 200 * common / (len + len), so inside one shared part the
    shortest customer key is best: one customer per part is enough, and the
    longest part two keys share is their longest common subsequence.
    """
    per_part = (
        _subsequences(customers, "natural_key")
        .groupBy("tenant_id", "part")
        .agg(F.min(F.struct(F.length("natural_key").alias("len"), "natural_key")).alias("best"))
    )
    shared = _subsequences(orphans, "link_key").join(per_part, ["tenant_id", "part"])
    return shared.select(
        "tenant_id",
        "link_key",
        F.col("best.natural_key").alias("natural_key"),
        (200.0 * F.length("part") / (F.length("link_key") + F.col("best.len"))).alias("score"),
    )


def _nearest_long(orphans: DataFrame, customers: DataFrame) -> DataFrame:
    """Pairs that may reach the score among longer keys, then the score itself.

    Keys at most d edits apart share one of d + 1 equal segments of the customer
    key, displaced by at most d places; the join is on that segment. Segments of
    a key are cut for each length the orphan may have, so nothing is missed.
    """
    ratio = (200 - 2 * SUGGEST_AT) / 200.0
    low, high = SUGGEST_AT / (200.0 - SUGGEST_AT), (200.0 - SUGGEST_AT) / SUGGEST_AT
    lengths = F.sequence(F.ceil(F.length("natural_key") * low).cast("int"),
                         F.floor(F.length("natural_key") * high).cast("int"))
    cut = customers.select("tenant_id", "natural_key", F.explode(lengths).alias("other"))
    cut = cut.withColumn("_d", F.floor(ratio * (F.length("natural_key") + F.col("other")) + 1e-9).cast("int"))
    place = F.explode(F.sequence(F.lit(0), F.col("_d")))
    cut = cut.select("*", place.alias("slot"))
    edge = lambda s: F.floor(s * F.length("natural_key") / (F.col("_d") + 1)).cast("int")
    start, stop = edge(F.col("slot")), edge(F.col("slot") + 1)
    segments = cut.select(
        "tenant_id", "natural_key", "other", start.alias("at"), (stop - start).alias("size"), "_d",
        F.col("natural_key").substr(start + 1, stop - start).alias("segment"),
    ).where(F.col("size") > 0)
    shapes = segments.select("tenant_id", "other", "at", "size", "_d").distinct()
    windows = (
        orphans.withColumn("other", F.length("link_key"))
        .join(shapes, ["tenant_id", "other"])
        .select("tenant_id", "link_key", "other", "at", "size", "_d",
                F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("_d")),
                                     F.col("at") + F.col("_d"))).alias("_p"))
        .where(F.col("_p") + F.col("size") <= F.col("other"))
        .select("tenant_id", "link_key", "other", "at", "size", "_d",
                F.col("link_key").substr(F.col("_p") + 1, F.col("size")).alias("segment"))
        .distinct()
    )
    pairs = (
        windows.join(segments, ["tenant_id", "other", "at", "size", "_d", "segment"])
        .select("tenant_id", "link_key", "natural_key")
        .distinct()
    )
    return pairs.withColumn("score", indel_ratio_udf("link_key", "natural_key"))


def suggest_customer_fix(orphans: DataFrame, customers: DataFrame) -> DataFrame:
    """(tenant_id, link_key, natural_key, score, suggested_fix) for orphan keys.

    Highest `indel ratio` of at least 85 over all of the tenant's customers;
    equal scores go to the smallest natural key. Keys of up to 15 characters meet
    by shared subsequences, which is exact. Longer ones meet that way when few
    edits apart; only orphans without so near a match go on to the segments.
    """
    keys = orphans.select("tenant_id", "link_key").where(F.col("link_key").isNotNull()).distinct()
    known = customers.select("tenant_id", "natural_key")
    near = _best(_nearest_by_parts(keys, known))
    # What the parts cannot show differs by more than LONG_KEY_REMOVALS edits.
    longest = F.floor(F.length("link_key") * (200.0 - SUGGEST_AT) / SUGGEST_AT)
    unseen = 100.0 * (1 - (LONG_KEY_REMOVALS + 1) / (F.length("link_key") + longest))
    open_keys = (
        keys.where(F.ceil(F.length("link_key") * (200.0 - SUGGEST_AT) / SUGGEST_AT) > SHORT_KEY)
        .join(near, ["tenant_id", "link_key"], "left")
        .where(F.coalesce(-F.col("best.rank"), F.lit(0.0)) <= unseen)
        .select("tenant_id", "link_key")
    )
    far = _nearest_long(open_keys, known)
    best = _best(near.select("tenant_id", "link_key", "best.natural_key", (-F.col("best.rank")).alias("score"))
                 .unionByName(far))
    shown = F.bround(-F.col("best.rank"), 0).cast("int").cast("string")
    return best.select(
        "tenant_id",
        "link_key",
        F.col("best.natural_key").alias("natural_key"),
        F.round(-F.col("best.rank"), 4).alias("score"),
        F.concat(F.lit("Map to existing customer '"), "best.natural_key", F.lit("' ("), shown, F.lit("% match)"))
        .alias("suggested_fix"),
    )


def _best(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("score") >= SUGGEST_AT)
        .groupBy("tenant_id", "link_key")
        .agg(F.min(F.struct((-F.col("score")).alias("rank"), "natural_key")).alias("best"))
    )
