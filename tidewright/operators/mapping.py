"""From column profiles to a mapping spec: score, rank, bucket, build, version.

Columns meet only the fields of their source kind, in an equi-join with the
registry. Everything here is metadata: one row per column and candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.functions.hashing import stable_id
from tidewright.functions.similarity import token_set_udf
from tidewright.functions.text import normalize_name
from tidewright.functions.vectors import cosine, embed

# Weights of the three signals and the bucket limits.
NAME_WEIGHT, VECTOR_WEIGHT, TYPE_WEIGHT = 0.45, 0.35, 0.20
AUTO_ACCEPT, HUMAN_CONFIRM = 0.85, 0.55
UNKNOWN = "UNKNOWN"

ENTRY = (
    "struct<source_column:string,transform:struct<function:string,params:map<string,string>>,"
    "provenance:struct<method:string,model:string,confidence:double,reasoning:string>>"
)


def pool_name(source_kind: Column) -> Column:
    """Which candidate pool a source kind draws on; any for unknown kinds."""
    return F.when(source_kind.isin(*registry.TABLES_BY_KIND), source_kind).otherwise("any")


def with_candidates(columns: DataFrame) -> DataFrame:
    """One row per column and candidate field of its kind (`source_kind`)."""
    pool = F.broadcast(registry.pool_frame(columns.sparkSession))
    return columns.withColumn("pool", pool_name(F.col("source_kind"))).join(pool, "pool").drop("pool")


def name_scores(columns: DataFrame) -> DataFrame:
    """(column_name, canonical_field, name_score): best of the field's names.

    Scored per distinct column name, over all fields' names and aliases.
    """
    spark = columns.sparkSession
    names = [(f.name, n) for f in registry.FIELDS.values() for n in (f.name, *f.aliases)]
    spelled = spark.createDataFrame(names, "canonical_field string, spelling string")
    wanted = with_candidates(columns.select("column_name", "source_kind").distinct())
    pairs = (
        wanted.select("column_name", "canonical_field").distinct()
        .join(F.broadcast(spelled), "canonical_field")
        .withColumn("a", normalize_name(F.col("column_name")))
        .withColumn("b", normalize_name(F.col("spelling")))
    )
    scored = pairs.withColumn("score", token_set_udf("a", "b"))
    return scored.groupBy("column_name", "canonical_field").agg((F.max("score") / 100.0).alias("name_score"))


def type_score(field_type: Column) -> Column:
    """How well a column's values fit a field type, from its profile."""
    filled = F.col("row_count") - F.col("null_count")
    return (
        F.when(field_type == "email", F.col("email_match_fraction"))
        .when(field_type == "phone", F.col("phone_match_fraction"))
        .when(field_type.isin("date", "datetime"), F.col("date_parse_fraction"))
        .when(field_type == "integer", F.col("int_parse_fraction"))
        .when(field_type == "money_minor_units", F.col("float_parse_fraction"))
        .when(field_type == "currency_code", F.col("currency_code_match_fraction"))
        .when(field_type == "enum",
              F.when(filled == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.least("distinct_fraction", F.lit(1.0)))))
        .otherwise(0.5)
    )


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= AUTO_ACCEPT, "auto_accept").when(confidence >= HUMAN_CONFIRM, "human_confirm").otherwise("unmapped")


def description(column_name: Column, samples: Column) -> Column:
    return F.concat(column_name, F.lit(": sample values are "), F.array_join(F.slice(samples, 1, 5), ", "))


def score_columns(
    profiles: DataFrame, by: list[str], embedder: Callable[[DataFrame, str, str], DataFrame] = embed
) -> DataFrame:
    """Ranked candidates of every column of every batch.

    `profiles` holds profile rows plus `source_kind`. Candidates are ranked by
    rounded confidence; ties keep registry order.
    """
    spark = profiles.sparkSession
    texts = profiles.withColumn("_text", description(F.col("column_name"), F.col("sample_values")))
    columns = embedder(texts, "_text", "_vector").drop("_text")
    described = [(f.name, f.description) for f in registry.FIELDS.values()]
    fields = embedder(spark.createDataFrame(described, "canonical_field string, _about string"), "_about", "_field_vector")
    names = name_scores(profiles)
    scored = (
        with_candidates(columns)
        .join(F.broadcast(fields.drop("_about")), "canonical_field")
        .join(names, ["column_name", "canonical_field"])
        .withColumn("embedding_score", cosine(F.col("_vector"), F.col("_field_vector")))
        .withColumn("type_score", type_score(F.col("type")))
        .withColumn(
            "confidence",
            F.round(NAME_WEIGHT * F.col("name_score") + VECTOR_WEIGHT * F.col("embedding_score")
                    + TYPE_WEIGHT * F.col("type_score"), 4),
        )
    )
    kind = [c for c in ("source_kind",) if c not in by]
    order = Window.partitionBy(*by, "column_name", *kind).orderBy(F.desc("confidence"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        *by, "column_name", *kind, "rank", "canonical_field", "confidence",
        *[F.round(c, 4).alias(c) for c in ("name_score", "embedding_score", "type_score")],
    )


def baseline_ranking(columns: DataFrame, by: list[str]) -> DataFrame:
    """Candidates ranked by name alone; ties keep registry order."""
    scored = with_candidates(columns).join(name_scores(columns), ["column_name", "canonical_field"])
    kind = [c for c in ("source_kind",) if c not in by]
    order = Window.partitionBy(*by, "column_name", *kind).orderBy(F.desc("name_score"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        *by, "column_name", *kind, "rank", "canonical_field", F.round("name_score", 4).alias("name_score")
    )


def column_mappings(ranked: DataFrame, by: list[str]) -> DataFrame:
    """One row per column: candidates in order, the best field, its bucket."""
    parts = F.struct("rank", "canonical_field", "confidence", "name_score", "embedding_score", "type_score")
    grouped = ranked.groupBy(*by, "column_name").agg(F.array_sort(F.collect_list(parts)).alias("candidates"))
    best = F.get("candidates", F.lit(0))
    return grouped.select(
        *by, "column_name", "candidates", best["canonical_field"].alias("best_field"),
        best["confidence"].alias("confidence"), bucket(best["confidence"]).alias("bucket"),
    )


def tiebreak_requests(mappings: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """What a reviewer (or model) is asked about columns no field fits well."""
    about = registry.registry_frame(mappings.sparkSession).select(
        F.col("name").alias("canonical_field"), "ordinal", F.concat(F.lit("- "), "name", F.lit(": "), "description").alias("line")
    )
    asked = mappings.where(F.col("bucket") == "unmapped").join(
        profiles.select(*by, "column_name", "source_kind", "sample_values"), [*by, "column_name"]
    )
    lines = with_candidates(asked.select(*by, "column_name", "source_kind")).drop("ordinal").join(F.broadcast(about), "canonical_field")
    listed = lines.groupBy(*by, "column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("lines")
    )
    samples = F.coalesce(F.nullif(F.array_join(F.slice("sample_values", 1, 5), ", "), F.lit("")), F.lit("none"))
    return asked.join(listed, [*by, "column_name"]).select(
        *by, "column_name",
        F.concat(F.lit("Column: "), "column_name", F.lit("\nSamples: "), samples, F.lit("\nFields:\n"), "lines").alias("request"),
    )


def spec_entries(mappings: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by..., canonical_field, entry): what each field is filled from.

    `mappings` needs column_name, best_field, confidence, bucket, source_kind;
    `decisions` (by..., column_name, field, model, confidence, reasoning) bears
    only on unmapped columns and on fields of their pool. UNKNOWN drops the
    column. If two columns claim a field, the last by (length, name) has it.
    """
    pools = registry.pool_frame(mappings.sparkSession).select("pool", F.col("canonical_field").alias("decided"))
    allowed = F.broadcast(pools.unionByName(pools.select("pool", F.lit(UNKNOWN).alias("decided")).distinct()))
    answers = decisions.select(
        *by, "column_name", F.col("field").alias("decided"),
        F.struct(F.lit("llm").alias("method"), "model", F.round("confidence", 4).alias("confidence"), "reasoning").alias("_answer"),
    )
    asked = mappings.withColumn("pool", pool_name(F.col("source_kind")))
    judged = (
        asked.join(answers, [*by, "column_name"], "left")
        .join(allowed.withColumn("_valid", F.lit(True)), ["pool", "decided"], "left")
        .withColumn("_use", F.coalesce(F.col("_valid") & (F.col("bucket") == "unmapped"), F.lit(False)))
    )
    own = F.struct(
        F.when(F.col("bucket") == "unmapped", "deterministic_fallback").otherwise("deterministic").alias("method"),
        F.lit(None).cast("string").alias("model"),
        F.col("confidence"),
        F.lit(None).cast("string").alias("reasoning"),
    )
    transforms = registry.registry_frame(mappings.sparkSession).select(
        F.col("name").alias("canonical_field"), F.col("transform").alias("function")
    )
    chosen = (
        judged.select(
            *by, "column_name",
            F.when(F.col("_use"), F.col("decided")).otherwise(F.col("best_field")).alias("canonical_field"),
            F.when(F.col("_use"), F.col("_answer")).otherwise(own).alias("provenance"),
        )
        .where(F.col("canonical_field").isNotNull() & (F.col("canonical_field") != UNKNOWN))
        .groupBy(*by, "canonical_field")
        .agg(F.max_by(F.struct(F.col("column_name").alias("source_column"), "provenance"),
                      F.struct(F.length("column_name"), "column_name")).alias("last"))
        .join(F.broadcast(transforms), "canonical_field")
    )
    return chosen.select(
        *by, "canonical_field",
        F.struct(
            F.col("last.source_column").alias("source_column"),
            F.struct("function", F.create_map().cast("map<string,string>").alias("params")).alias("transform"),
            F.col("last.provenance").alias("provenance"),
        ).cast(ENTRY).alias("entry"),
    )


def spec_documents(entries: DataFrame, by: list[str]) -> DataFrame:
    """One spec (map of field to entry) per group."""
    return entries.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("canonical_field", "entry"))).alias("spec"))


def next_versions(specs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Draft rows for new documents: version max + 1, parent the latest one.

    Earlier specs are never changed. `drafts` has (tenant_id, source_id, spec).
    """
    key = ["tenant_id", "source_id"]
    latest = specs.groupBy(*key).agg(F.max("version").alias("parent_version"))
    version = F.coalesce(F.col("parent_version"), F.lit(0)) + 1
    return drafts.join(latest, key, "left").select(
        stable_id("spec", F.col("tenant_id"), F.col("source_id"), version.cast("string")).alias("id"),
        *key, version.alias("version"), "spec", F.lit("draft").alias("status"), "parent_version",
    )


def patch_specs(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lay human overrides over draft specs; `_patch` tells what happened.

    `overrides` is (id, patch map<field, entry>): an entry replaces the field's,
    a null one removes it. Missing transforms and provenance are filled in.
    Specs that are not drafts are refused and stay as they are.
    """
    functions = F.create_map(*[F.lit(x) for f in registry.FIELDS.values() for x in (f.name, f.transform)])

    def filled(name: Column, e: Column) -> Column:
        transform = F.coalesce(
            e["transform"],
            F.struct(functions[name].alias("function"), F.create_map().cast("map<string,string>").alias("params")),
        )
        human = F.struct(F.lit("human").alias("method"), F.lit(None).cast("string").alias("model"),
                         F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
        return F.struct(e["source_column"].alias("source_column"), transform.alias("transform"),
                        F.coalesce(e["provenance"], human).alias("provenance")).cast(ENTRY)

    kept = F.map_filter("spec", lambda k, v: ~F.array_contains(F.map_keys("patch"), k))
    laid = F.transform_values(F.map_filter("patch", lambda k, v: v.isNotNull()), filled)
    patch = F.col("patch").isNotNull()
    draft = F.col("status") == "draft"
    return specs.join(overrides.select("id", "patch"), "id", "left").select(
        *[c for c in specs.columns if c != "spec"],
        F.when(patch & draft, F.map_concat(kept, laid)).otherwise(F.col("spec")).alias("spec"),
        F.when(patch & draft, "patched").when(patch, "refused").alias("_patch"),
    )


def confirm_specs(specs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Confirm chosen drafts (`id`); earlier confirmed ones are superseded.

    `_confirm` is confirmed, refused (not a draft) or null. At most one spec
    per source is confirmed at a time.
    """
    key = ["tenant_id", "source_id"]
    marked = specs.join(chosen.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    accepted = F.col("_chosen") & (F.col("status") == "draft")
    sources = marked.where(accepted).groupBy(*key).agg(F.max("version").alias("_now"))
    out = marked.join(sources, key, "left")
    current = F.coalesce(accepted, F.lit(False)) & (F.col("version") == F.col("_now"))
    replaced = F.col("_now").isNotNull() & (
        (F.col("status") == "confirmed") | (F.coalesce(accepted, F.lit(False)) & (F.col("version") < F.col("_now")))
    )
    return out.select(
        *[c for c in specs.columns if c != "status"],
        F.when(current, "confirmed").when(replaced, "superseded").otherwise(F.col("status")).alias("status"),
        F.when(F.coalesce(accepted, F.lit(False)), "confirmed").when(F.col("_chosen"), "refused").alias("_confirm"),
    )


def confirmed_specs(specs: DataFrame) -> DataFrame:
    return specs.where(F.col("status") == "confirmed")


def assignments(specs: DataFrame) -> DataFrame:
    """Reverse view of specs: which field each source column fills, and how."""
    return specs.select("id", "tenant_id", "source_id", "version", F.explode("spec").alias("canonical_field", "entry")).select(
        "id", "tenant_id", "source_id", "version", F.col("entry.source_column").alias("source_column"), "canonical_field",
        F.col("entry.transform.function").alias("function"), F.col("entry.provenance.method").alias("method"),
    )


def as_document(row_spec: Mapping) -> dict[str, dict]:
    """A spec as read from a row (map of structs), in the form `apply_spec` takes."""
    return {
        name: {
            "source_column": e["source_column"],
            "transform": {"function": e["transform"]["function"], "params": dict(e["transform"]["params"] or {})},
        }
        for name, e in row_spec.items()
    }
