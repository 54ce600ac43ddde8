"""Probable duplicate customers: block, score, list, merge.

Scoring is Fellegi-Sunter with fixed match and non-match probabilities. Which
comparison levels can reach the threshold together is worked out beforehand, so
only blocks that can yield a candidate are formed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.hashing import stable_id
from tidewright.functions.similarity import jaro_winkler_udf
from tidewright.operators.joins import key_counts, spread_lookup
from tidewright.session import reliable

# Prior odds and (match, non-match) probability per level.
PRIOR_ODDS = 0.01 / 0.99
NAME_LEVELS = {"exact": (0.85, 0.001), "close": (0.5, 0.02), "alike": (0.3, 0.05), "other": (0.02, 0.9)}
EMAIL_LEVELS = {"exact": (0.95, 0.001), "other": (0.05, 0.999)}
COUNTRY_LEVELS = {"exact": (0.6, 0.3), "other": (0.4, 0.7)}
NAME_LIMITS = {"close": 0.9, "alike": 0.7}
TILE_ROWS = 2000


def _factor(levels: dict, level: str) -> float:
    match, other = levels[level]
    return match / other


def _probability(name: str, email: str | None, country: str | None) -> float:
    odds = PRIOR_ODDS * _factor(NAME_LEVELS, name)
    odds *= _factor(EMAIL_LEVELS, email) if email else 1.0
    odds *= _factor(COUNTRY_LEVELS, country) if country else 1.0
    return odds / (1 + odds)


def signatures(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers that agree in name, email and country, collapsed to one.

    Returns (members, signatures): members map every customer to the smallest
    id of its group; a group of copies is compared once, not pair by pair.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    compared = customers.select(
        "tenant_id", "id", "legal_name", blank("email").alias("email"), blank("country").alias("country")
    )
    key = ["tenant_id", "legal_name", "email", "country"]
    groups = compared.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_facts"))
    # the group's id goes back to its customers; large groups are spread
    members = spread_lookup(
        compared.withColumnRenamed("id", "customer_id"), groups, key, ["customer_id"]
    ).select("tenant_id", "customer_id", *key[1:], F.col("id").alias("representative"))
    return members, groups.select(*key, "id")


def blocked_pairs(sigs: DataFrame, block: Column, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of signatures that share a block, each once, small id first.

    A large block is cut into tiles of about `tile_rows` and the self-join runs
    tile against tile, so one block is the work of many tasks.
    """
    blocked = sigs.withColumn("_block", block).where(F.col("_block").isNotNull())
    key = ["tenant_id", "_block"]
    sizes = key_counts(blocked, key).where(F.col("_facts") > 1)
    tiles = F.ceil(F.col("_facts") / F.lit(tile_rows)).cast("int")
    sized = spread_lookup(blocked, sizes.withColumn("_tiles", tiles), key, ["id"]).where(
        F.col("_tiles").isNotNull()
    )
    tiled = sized.withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    columns = ["tenant_id", "_block", "_tile", "id", "legal_name", "email", "country"]
    lows = tiled.select(*columns, F.explode(F.sequence(F.col("_tile"), F.col("_tiles") - 1)).alias("_high"))
    highs = tiled.select(*columns)
    a = lows.select("tenant_id", "_block", F.col("_tile").alias("_low"), "_high", F.struct("id", "legal_name", "email", "country").alias("a"))
    b = highs.select("tenant_id", "_block", F.explode(F.sequence(F.lit(0), F.col("_tile"))).alias("_low"),
                     F.col("_tile").alias("_high"), F.struct("id", "legal_name", "email", "country").alias("b"))
    pairs = a.join(b, ["tenant_id", "_block", "_low", "_high"]).where(
        (F.col("_low") < F.col("_high")) | (F.col("a.id") < F.col("b.id"))
    )
    forward = F.col("a.id") < F.col("b.id")
    return pairs.select(
        "tenant_id",
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(forward, F.col("b")).otherwise(F.col("a")).alias("b"),
    )


def _outcomes(threshold: float, blank_is_null: bool) -> set[tuple[str, str | None]]:
    """(name level, email level) combinations that can reach the threshold."""
    missing = [None] if blank_is_null else []
    return {
        (name, email)
        for name, email, country in product(NAME_LEVELS, [*EMAIL_LEVELS, *missing], [*COUNTRY_LEVELS, *missing])
        if _probability(name, email, country) >= threshold
    }


def _levels(blank_is_null: bool) -> tuple[Column, Column]:
    def level(column: str) -> Column:
        same = F.when(F.col(f"a.{column}") == F.col(f"b.{column}"), "exact").otherwise("other")
        if not blank_is_null:
            return same
        return F.when((F.col(f"a.{column}") != "") & (F.col(f"b.{column}") != ""), same)

    return level("email"), level("country")


def _score(pairs: DataFrame, blank_is_null: bool) -> DataFrame:
    def weight(levels: dict, level: Column) -> Column:
        factor = F.lit(1.0)
        for name in levels:
            factor = F.when(level == name, F.lit(_factor(levels, name))).otherwise(factor)
        return factor

    email, country = _levels(blank_is_null)
    odds = (
        F.lit(PRIOR_ODDS) * weight(NAME_LEVELS, F.col("name_level")) * weight(EMAIL_LEVELS, email)
        * weight(COUNTRY_LEVELS, country)
    )
    return pairs.withColumn("_odds", odds).select(
        "tenant_id", F.col("a.id").alias("customer_id_a"), F.col("b.id").alias("customer_id_b"),
        (F.col("_odds") / (1 + F.col("_odds"))).alias("match_probability"),
    )


def _leveled(pairs: DataFrame) -> DataFrame:
    """Add `name_level`; equal names never reach the similarity function."""
    same = F.col("a.legal_name") == F.col("b.legal_name")
    exact = pairs.where(same).withColumn("name_level", F.lit("exact"))
    similar = pairs.where(~same).withColumn("_jw", jaro_winkler_udf("a.legal_name", "b.legal_name"))
    level = F.lit("other")
    for name, limit in sorted(NAME_LIMITS.items(), key=lambda item: item[1]):
        level = F.when(F.col("_jw") >= limit, name).otherwise(level)
    return exact.unionByName(similar.withColumn("name_level", level).drop("_jw"))


def duplicate_candidates(
    customers: DataFrame, threshold: float = 0.5, blank_is_null: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(tenant_id, customer_id_a, customer_id_b, match_probability) at or above the threshold.

    Candidates share the first three characters of the name, or the email. A
    group of customers that agree in all three compared values is linked to its
    smallest id, which alone is compared with others: each pair of the group, and
    each pair across groups, follows from these links with the same score.

    By default two blank emails (or countries) are equal evidence like any other
    value. With `blank_is_null` they say nothing and do not block; choose this
    where many customers have no email, for the default then compares all of
    them with each other.
    """
    members, sigs = signatures(customers)
    possible = _outcomes(threshold, blank_is_null)
    email_block = F.nullif("email", F.lit("")) if blank_is_null else F.col("email")
    blocks = [(email_block, F.lit(True))]
    other = [(n, e) for n, e in possible if e != "exact"]
    if other:
        # pairs with different (or missing) emails can pass: by name as well
        equal_names = all(n == "exact" for n, _ in other)
        name_block = F.col("legal_name") if equal_names else F.substring("legal_name", 1, 3)
        by_email = F.coalesce((F.col("a.email") == F.col("b.email")), F.lit(False))
        if blank_is_null:
            by_email = by_email & (F.col("a.email") != "")
        blocks.append((name_block, ~by_email))
    found = None
    for block, condition in blocks:
        scored = _score(_leveled(blocked_pairs(sigs, block, tile_rows).where(condition)), blank_is_null)
        found = scored if found is None else found.unionByName(scored)
    copies = members.where(F.col("customer_id") != F.col("representative"))
    as_pair = lambda i: F.struct(F.col(i).alias("id"), "legal_name", "email", "country")
    links = _score(
        copies.select("tenant_id", as_pair("representative").alias("a"), as_pair("customer_id").alias("b"),
                      F.lit("exact").alias("name_level")),
        blank_is_null,
    )
    return (
        found.unionByName(links)
        .where(F.col("match_probability") >= threshold)
        .withColumn("match_probability", F.round("match_probability", 4))
    )


def upsert_candidates(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Next state of the candidate table, with `_new` and `_found` (in this run).

    Pairs are kept small id first; a known pair keeps its status and takes the
    new probability, a new one is open. Pairs no longer found stay.
    """
    key = ["tenant_id", "customer_id_a", "customer_id_b"]
    ordered = found.select(
        "tenant_id", F.least("customer_id_a", "customer_id_b").alias("customer_id_a"),
        F.greatest("customer_id_a", "customer_id_b").alias("customer_id_b"), F.col("match_probability").alias("_p"),
    )
    both = existing.select(*key, "match_probability", "status").join(ordered, key, "full_outer")
    return both.select(
        stable_id("pair", *[F.col(c) for c in key]).alias("id"), *key,
        F.coalesce("_p", "match_probability").alias("match_probability"),
        F.coalesce("status", F.lit("open")).alias("status"), F.col("status").isNull().alias("_new"),
        F.col("_p").isNotNull().alias("_found"),
    )


def list_candidates(candidates: DataFrame, tenant_id: str, status: str | None = "open") -> DataFrame:
    out = candidates.where(F.col("tenant_id") == tenant_id)
    return out if status is None else out.where(F.col("status") == status)


def dismiss(candidates: DataFrame, chosen: Column) -> DataFrame:
    return candidates.withColumn("status", F.when(chosen, "dismissed").otherwise(F.col("status")))


def merge_map(pairs: DataFrame) -> DataFrame:
    """(tenant_id, loser, winner) of merges applied together, chains closed.

    Every connected group of customers goes to its smallest id. Alternating
    large-star and small-star steps (Kiveris et al., 2014): each is a minimum
    per node, aggregated map-side, given back to the node's edges; a customer
    in a third of all pairs is spread by `spread_lookup`.
    """
    edges = pairs.select(
        "tenant_id", F.greatest("customer_id_a", "customer_id_b").alias("u"), F.least("customer_id_a", "customer_id_b").alias("v")
    ).where(F.col("u") != F.col("v")).distinct()
    edges = reliable(edges)

    def stars(e: DataFrame) -> DataFrame:
        lowest = e.groupBy("tenant_id", "u").agg(F.min("v").alias("_min"), F.count(F.lit(1)).alias("_facts"))
        return spread_lookup(e, lowest, ["tenant_id", "u"], ["u", "v"])

    while True:  # settles in about log(size of the largest group) squared rounds
        both = edges.unionByName(edges.select("tenant_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both).select("tenant_id", "u", "v", F.least("u", "_min").alias("m")).where(F.col("v") > F.col("u"))
        large = large.select("tenant_id", F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        small = stars(large)
        small = (
            small.select("tenant_id", "u", F.col("_min").alias("m"))
            .unionByName(small.select("tenant_id", F.col("v").alias("u"), F.col("_min").alias("m")))
            .where(F.col("u") != F.col("m")).distinct()
            .select("tenant_id", "u", F.col("m").alias("v"))
        )
        after = reliable(small)
        changed = after.join(edges, ["tenant_id", "u", "v"], "left_anti").limit(1).count() + edges.join(
            after, ["tenant_id", "u", "v"], "left_anti"
        ).limit(1).count()
        edges = after
        if not changed:
            return edges.select("tenant_id", F.col("u").alias("loser"), F.col("v").alias("winner"))


def conflicting_merges(chosen: DataFrame, customers: DataFrame) -> DataFrame:
    """Chosen pairs of which a customer no longer exists."""
    known = customers.select("tenant_id", "id")
    a = known.withColumnRenamed("id", "customer_id_a")
    b = known.withColumnRenamed("id", "customer_id_b")
    complete = chosen.join(a, ["tenant_id", "customer_id_a"], "left_semi").join(b, ["tenant_id", "customer_id_b"], "left_semi")
    return chosen.join(complete, ["tenant_id", "customer_id_a", "customer_id_b"], "left_anti")


def repoint(records: DataFrame, merges: DataFrame, row_id: str = "id") -> DataFrame:
    """Records of merged customers, given to the winner.

    A merged customer may own a third of the records: these are spread.
    """
    on = ["tenant_id", "customer_id"]
    losers = merges.select("tenant_id", F.col("loser").alias("customer_id"), "winner")
    moved = losers.join(key_counts(records, on), on)
    joined = spread_lookup(records, moved, on, [row_id])
    return joined.withColumn("customer_id", F.coalesce("winner", "customer_id")).select(*records.columns)


def drop_merged(customers: DataFrame, merges: DataFrame) -> DataFrame:
    return customers.join(merges.select("tenant_id", F.col("loser").alias("id")), ["tenant_id", "id"], "left_anti")


def mark_merged(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """Candidate rows survive a merge as the record of the decision."""
    key = ["tenant_id", "customer_id_a", "customer_id_b"]
    flagged = candidates.join(merged.select(*key).distinct().withColumn("_m", F.lit(True)), key, "left")
    return flagged.withColumn("status", F.when(F.col("_m"), "merged").otherwise(F.col("status"))).select(*candidates.columns)
