from itertools import combinations

from pyspark.sql import functions as F

from tidewright.functions.hashing import stable_id


def test_ids_of_different_parts_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("", ""), ("-", None), ("é", "1:a"), ("1:é", "a")]
    ids = [r.id for r in spark.createDataFrame(rows, "x string, y string").select(stable_id(F.col("x"), F.col("y")).alias("id")).collect()]
    assert all(a != b for a, b in combinations(ids, 2))
    assert spark.range(1).select(stable_id("a", F.lit(5)) == stable_id("a", F.lit("5"))).first()[0]
