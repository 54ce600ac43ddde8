"""How good mappings and checks are, against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 3


def rankings(ranked: DataFrame, by: list[str], limit_to_mapped: DataFrame | None = None) -> DataFrame:
    """(by..., column_name, predicted, ranked) from rank rows."""
    listed = ranked.groupBy(*by, "column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical_field"))), lambda x: x["canonical_field"]).alias("ranked")
    )
    out = listed.withColumn("predicted", F.get("ranked", F.lit(0)))
    if limit_to_mapped is None:
        return out
    mapped = limit_to_mapped.select(*by, "column_name", (F.col("bucket") != "unmapped").alias("_mapped"))
    return out.join(mapped, [*by, "column_name"]).withColumn("predicted", F.when(F.col("_mapped"), F.col("predicted"))).drop("_mapped")


def mapping_accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy at 1 and 3, precision, recall per group.

    `predictions` has truth, predicted, ranked. A column without a true field
    can only count as a false positive.
    """
    truth, predicted = F.col("truth"), F.col("predicted")
    right = F.coalesce(truth == predicted, F.lit(False))
    in_top = F.coalesce(F.array_contains(F.slice("ranked", 1, TOP), truth), F.lit(False))
    counted = predictions.groupBy(*by).agg(
        F.count("truth").alias("mapped_columns"),
        F.count_if(right).alias("tp"),
        F.count_if(predicted.isNotNull() & ~right).alias("fp"),
        F.count_if(truth.isNotNull() & ~right).alias("fn"),
        F.count_if(in_top).alias("in_top"),
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    c = F.col
    return counted.select(
        *by, "mapped_columns", "tp", "fp", "fn",
        ratio(c("tp"), c("mapped_columns")).alias("acc_at_1"),
        ratio(c("in_top"), c("mapped_columns")).alias("acc_at_3"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
    )


def full_pass(predictions: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """Predictions with tie-break decisions laid over the unmapped columns;
    UNKNOWN or no answer falls back to the best field."""
    answers = decisions.select(*by, "column_name", F.col("field").alias("_decided"))
    decided = F.when(F.col("_decided") != "UNKNOWN", F.col("_decided"))
    return predictions.join(answers, [*by, "column_name"], "left").withColumn(
        "predicted", F.coalesce("predicted", decided, F.get("ranked", F.lit(0)))
    ).drop("_decided")


def defect_coverage(expected: DataFrame, quarantine: DataFrame, key: list[str]) -> DataFrame:
    """Per expected code: rows that should carry it, rows that do, rows missed.

    `expected` is (key..., codes array); `quarantine` (key..., error_codes).
    """
    joined = expected.join(quarantine.select(*key, "error_codes"), key, "left")
    found = F.coalesce("error_codes", F.array().cast("array<string>"))
    missed = F.array_except("codes", found)
    exploded = joined.select(F.explode("codes").alias("code"), missed.alias("missed"))
    return exploded.groupBy("code").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(~F.array_contains("missed", F.col("code"))).alias("found"),
        F.count_if(F.array_contains("missed", F.col("code"))).alias("missed"),
    )
