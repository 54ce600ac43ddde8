"""Quantiles of the numeric report."""

import math
import random

from pyspark.sql import functions as F

from tidewright.operators import profile

NAMES = [f"p{round(q * 100):02d}" for q in profile.QUANTILES]


def test_quantiles_are_exact_in_a_large_table(spark):
    n = 3_000_000
    # every number from 0 to n - 1 once, in scattered order: the value of a rank is the rank less one
    df = spark.range(n, numPartitions=7).select(((F.col("id") * 7_368_787 + 11) % n).alias("a"), (F.col("id") % 1000).cast("double").alias("b"))
    got = {r["column_name"]: [r[x] for x in NAMES] for r in profile.numeric_report(df, ["a", "b"]).collect()}
    assert got["a"] == [math.ceil(n * round(q * 100) / 100) - 1 for q in profile.QUANTILES]
    assert got["b"] == [round(1000 * q) - 1 for q in profile.QUANTILES]


def test_quantiles_of_odd_columns(spark):
    r = random.Random(3)
    values = [r.choice([None, -1.5, 0.0, 2.0, 7.25]) for _ in range(207)]
    rows = [(x, None, 4.0 if i == 9 else None) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, none double, one double")
    report = {r["column_name"]: r for r in profile.numeric_report(df, ["x", "none", "one"]).collect()}
    ranked = sorted(x for x in values if x is not None)
    wanted = [ranked[max(1, -(-len(ranked) * round(q * 100) // 100)) - 1] for q in profile.QUANTILES]
    assert [report["x"][k] for k in NAMES] == wanted and [report["one"][k] for k in NAMES] == [4.0] * 5
    assert [report["none"][k] for k in NAMES] == [None] * 5 and report["none"]["missing"] == 207
    empty = profile.numeric_report(df.limit(0), ["x"]).collect()
    assert len(empty) == 1 and empty[0]["rows"] == 0 and empty[0]["p50"] is None


def test_states_merge_to_the_profile_of_all_cells(spark):
    r = random.Random(8)
    pool = ["", " ", None, "2024-01-05", "5/6/2024", "31-12-2023", "7", "-3", "1e5", "a@b.c", "+1 555 0100", "EUR", "é", "ÀÉ", "x" * 300, *(f"v{i}" for i in range(90))]
    rows = [(batch, column, r.choice(pool[: r.choice([3, 16, len(pool)])])) for batch in range(5) for column in "abc" for _ in range(r.randrange(1, 120))]
    rows += [(9, "none", None), (9, "two", "b"), (9, "two", "a"), (9, "two", "a")]
    cells = spark.createDataFrame(rows, "batch int, column_name string, value string").repartition(7)
    whole = {x["column_name"]: x.asDict() for x in profile.profile(cells.drop("batch")).collect()}
    numbers, hashes = profile.states(cells, ["batch"])
    halves = [profile.merge_states(numbers.where(c), hashes.where(c)) for c in ("batch < 3", "batch >= 3")]
    merged = profile.merge_states(halves[0][0].unionByName(halves[1][0]), halves[0][1].unionByName(halves[1][1]))
    assert {x["column_name"]: x.asDict() for x in profile.profile_of_states(*merged).collect()} == whole
    for column, got in whole.items():
        values = [v for _, c, v in rows if c == column]
        filled = [v for v in values if v is not None]
        assert (got["row_count"], got["null_count"], got["distinct_count"]) == (len(values), len(values) - len(filled), len(set(filled)))
        assert got["sample_values"] == sorted(set(filled), key=lambda v: v.encode())[:5]
        share = lambda test: sum(map(test, filled)) / len(filled) if filled else 0.0
        assert math.isclose(got["currency_code_match_fraction"], share(lambda v: len(v) == 3 and v.isascii() and v.isalpha()))
        assert math.isclose(got["date_parse_fraction"], share(lambda v: v in ("2024-01-05", "5/6/2024", "31-12-2023")))
    one = {(x["batch"], x["column_name"]) for x in profile.profile(cells, ["batch"]).collect()}
    assert one == {(b, c) for b, c, _ in rows}
    assert profile.profile(cells.limit(0).drop("batch")).count() == 0


def test_cells_meet_their_bound_without_a_shuffle(spark):
    """Only the small tables of numbers and samples are sorted and merged; all cells of a column would go to one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.range(500).selectExpr("concat('c', id % 2) as column_name", "concat('v', id div 2) as value")
        numbers, _ = profile.states(cells)
        assert numbers._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("SortMergeJoin") == 1
        assert [r["sample_values"] for r in numbers.collect()] == [["v0", "v1", "v10", "v100", "v101"]] * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
