"""Column profiles: every statistic of every column, from states that add up.

Rows become (column, value) pairs; they are tested and counted where they lie,
and only numbers, hashes of distinct values and a few small values are shuffled.
The states of batches merge into the profile of all of them, without their cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable

# The shapes that are recognised.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^[\d\-\+\(\)\s]{7,20}$"
CURRENCY = r"^[A-Za-z]{3}$"
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
)
SAMPLES = 5
FRACTIONS = ("date_parse", "int_parse", "float_parse", "email_match", "phone_match", "currency_code_match")


def cells_of_raw(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value) of landed rows."""
    return raw.select(*by, F.explode("raw").alias("column_name", "value"))


def cells_of_table(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value) of a table, every value as text."""
    names = [c for c in (columns or df.columns) if c not in by]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                for c in names]))
    return df.select(*by, pairs.alias("_cell")).select(*by, "_cell.*")


def _is_date(v: Column) -> Column:
    shaped = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_SHAPES):
        shaped = F.when(v.rlike(shape), F.try_to_date(v, pattern)).otherwise(shaped)
    return shaped.isNotNull()


def value_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _tests(v: Column) -> dict[str, Column]:
    return {
        "date_parse": _is_date(v),
        "int_parse": v.rlike(INTEGER) & v.try_cast("bigint").isNotNull(),
        "float_parse": v.rlike(f"(?i){FLOAT}"),
        "email_match": v.rlike(EMAIL),
        "phone_match": v.rlike(PHONE),
        "currency_code_match": v.rlike(CURRENCY),
    }


BUCKETS = 64


def states(cells: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mergeable profile states of some cells, which are small beside them: (numbers, hashes).

    `numbers` has a row per (by..., column): `rows`, `nulls`, how many values pass each test, and the five smallest
    values. `hashes` has the distinct values as 128-bit hashes. Tests are summed map-side; what is shuffled is a few
    numbers and 16-byte hashes, and of the texts only those that may be among the five smallest: values are dealt into
    64 buckets, the fifth smallest of the buckets' minima bounds the fifth smallest value.
    """
    group = [*by, "column_name"]
    v = F.col("value")
    passed = [F.count_if(test).alias(name) for name, test in _tests(v).items()]
    # one pass gives the numbers and the minima; their shuffle is used twice
    dealt = cells.groupBy(*group, F.pmod(F.xxhash64(v), F.lit(BUCKETS)).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), *passed, F.min(v).alias("_min"))
    numbers = dealt.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", *FRACTIONS)])
    valued = cells.where(v.isNotNull())
    hashes = valued.select(*group, F.unhex(F.md5(v)).alias("hash")).distinct()
    bound = dealt.groupBy(*group).agg(F.array_sort(F.collect_list("_min")).alias("_mins")).select(
        *group, F.when(F.size("_mins") >= SAMPLES, F.get("_mins", F.lit(SAMPLES - 1))).alias("_bound"))
    # a row per column: broadcast, so that no cell is shuffled to meet its bound
    low = valued.join(F.broadcast(bound), group).where(F.col("_bound").isNull() | (v <= F.col("_bound"))).select(*group, "value").distinct()
    return numbers.join(_smallest(low, group), group, "left"), hashes


def _smallest(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """The five smallest of distinct values; `row_number() <= 5` is cut to five per map task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("value"))
    return values.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLES).groupBy(*group).agg(
        F.array_sort(F.collect_list("value")).alias("sample_values"))


def merge_states(numbers: DataFrame, hashes: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The states of several batches (in union) as one, without their cells. States of states merge alike."""
    group = [*by, "column_name"]
    summed = numbers.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", *FRACTIONS)])
    samples = _smallest(numbers.select(*group, F.explode("sample_values").alias("value")).distinct(), group)
    return summed.join(samples, group, "left"), hashes.select(*group, "hash").distinct()


def profile_of_states(numbers: DataFrame, hashes: DataFrame, by: Sequence[str] = (), total_rows: DataFrame | None = None) -> DataFrame:
    """The 13 statistics of a state, one row per (by..., column); `total_rows` as for `profile`."""
    group = [*by, "column_name"]
    distinct = hashes.groupBy(*group).agg(F.count(F.lit(1)).alias("distinct_count"))
    counted = numbers.join(distinct, group, "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
    if total_rows is None:
        counted = counted.withColumn("row_count", F.col("rows"))
    elif by:
        counted = counted.join(total_rows.select(*by, F.col("rows").alias("row_count")), list(by))
    else:
        counted = counted.withColumn("row_count", F.lit(total_rows.first()["rows"]))
    filled = F.col("rows") - F.col("nulls")
    share = lambda c: F.when(filled > 0, F.col(c) / filled).otherwise(F.lit(0.0))
    null_count = F.col("row_count") - filled
    return counted.select(
        *group,
        "row_count",
        null_count.alias("null_count"),
        F.when(F.col("row_count") > 0, null_count / F.col("row_count")).otherwise(F.lit(0.0)).alias("null_fraction"),
        "distinct_count",
        share("distinct_count").alias("distinct_fraction"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        *[share(name).alias(f"{name}_fraction") for name in FRACTIONS],
    )


def profile(cells: DataFrame, by: Sequence[str] = (), total_rows: DataFrame | None = None) -> DataFrame:
    """The 13 statistics, one row per (by..., column).

    Landed rows may lack a key altogether; `total_rows` (by..., rows) then says
    how many rows there are, and absent keys count as null.
    """
    return profile_of_states(*states(cells, by), by, total_rows)


def profile_raw(raw: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Profiles of landed batches."""
    totals = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    return profile(cells_of_raw(raw, by), by, totals)


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, p05...): the smallest value that at least this share of a column's values does not exceed.

    Exact at any size. Values are counted map-side and laid out by range; the
    sums of the ranges tell which of them hold a wanted rank, and only in
    these are the counts added up value by value.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                                          for c in columns])).alias("_cell")).select("_cell.*")
    counts = value_counts(cells.where(F.col("value").isNotNull()))
    counts = reliable(counts.repartitionByRange("column_name", "value").withColumn("_part", F.spark_partition_id()))
    parts = counts.groupBy("column_name", "_part").agg(F.min("value").alias("_from"), F.sum("n").alias("_held"))
    column = Window.partitionBy("column_name")
    up_to = F.sum("_held").over(column.orderBy("_from").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select("column_name", "_part", "_held", (up_to - F.col("_held")).alias("_before"), F.sum("_held").over(column).alias("_all"))
    ranks = F.explode(F.array(*[F.struct(F.lit(f"p{round(q * 100):02d}").alias("_name"), F.expr(
        f"greatest(1, (_all * {round(q * 100)} + 99) div 100)").alias("_rank")) for q in QUANTILES]))
    wanted = parts.select("*", ranks.alias("_w")).select("*", "_w.*").where(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_held")))
    wanted = wanted.select("column_name", "_part", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"))
    held = counts.join(wanted.select("column_name", "_part").distinct(), ["column_name", "_part"], "left_semi")
    last = F.sum("n").over(Window.partitionBy("column_name", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.withColumn("_last", last).join(wanted, ["column_name", "_part"]).where(
        (F.col("_rank") <= F.col("_last")) & (F.col("_rank") > F.col("_last") - F.col("n")))
    names = [f"p{round(q * 100):02d}" for q in QUANTILES]
    return found.groupBy("column_name").agg(*[F.max(F.when(F.col("_name") == x, F.col("value"))).alias(x) for x in names])


def numeric_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Report of numeric columns: counts, moments, extremes, exact quantiles.

    One aggregate over the wide table, and one shuffle of the columns' counted
    values for the quantiles.
    """
    measures = []
    for c in columns:
        x = F.col(c).cast("double")
        measures += [
            F.count(F.lit(1)).alias(f"{c}__rows"),
            F.count_if(x.isNull()).alias(f"{c}__missing"),
            F.count_if(x == 0).alias(f"{c}__zeros"),
            F.count_if(x < 0).alias(f"{c}__negative"),
            F.min(x).alias(f"{c}__minimum"),
            F.max(x).alias(f"{c}__maximum"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
        ]
    wide = df.agg(*measures)
    kept = ("rows", "missing", "zeros", "negative", "minimum", "maximum", "mean", "std")
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{c}__{m}").alias(m) for m in kept],
        )
        for c in columns
    ]
    report = wide.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")
    return report.join(quantiles(df, columns), "column_name", "left")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column_name, bin, lower, upper, rows): equal-width bins from min to max."""
    limits = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in columns
                      for k, f in (("lo", F.min), ("hi", F.max))]).first()
    entries = []
    for c in columns:
        lo, hi = limits[f"{c}__lo"], limits[f"{c}__hi"]
        width = ((hi - lo) / bins) if lo is not None and hi > lo else 1.0
        place = F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        entries.append(F.struct(F.lit(c).alias("column_name"), place.cast("int").alias("bin"),
                                F.lit(lo).cast("double").alias("lo"), F.lit(width).alias("width")))
    return (
        df.select(F.explode(F.array(*entries)).alias("_b")).select("_b.*").where(F.col("bin").isNotNull())
        .groupBy("column_name", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("rows"))
        .select("column_name", "bin", F.round(F.col("lo") + F.col("bin") * F.col("width"), 4).alias("lower"),
                F.round(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 4).alias("upper"), "rows")
    )


def top_values(cells: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per column (the report's common-values table)."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        value_counts(cells).where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("column_name", "rank", "value", F.col("n").alias("rows"))
    )
