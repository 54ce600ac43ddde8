"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and each segment's values index the codes. For radius r = 0, 1, 2, ... a query looks up
every segment value exactly r bits from its own and verifies the whole codes it finds. With m segments, a code within
m (r + 1) - 1 bits has some segment within r bits, so once the k-th best verified distance is at most that, the answer
is proven and the query stops. Segments are about log2(n) bits wide, which keeps buckets short at every size.

The index holds each distinct code once, with its k + 1 smallest ids (one may be the query itself), so a common code
is one entry and its bucket grows no further. Answers are ordered by distance, then id.

Results for odd rows: rows without an id or a vector are not indexed and ask nothing. Missing components count as not
positive, those after the last bit are not used. Repeated rows count once; one id with several codes is several
entries and several queries, of which the nearest counts. A query never finds its own id. Fewer than k other rows give
fewer answers. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import reliable


@dataclass(frozen=True)
class Params:
    k: int = 10
    bits: int = 64
    query_step: int = 50  # rows whose id it divides are the queries


DEFAULT = Params()


def sign_code(vector: Column, bits: int) -> Column:
    """Bit i is set if component i is positive."""
    set_bit = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(
        F.coalesce(F.get(vector, i) > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment_widths(n: int, bits: int) -> list[int]:
    """Widths of the segments for n codes: about log2(n) bits each, none over 20."""
    m = max(1, round(bits / min(20, max(4, n.bit_length() - 1))))
    return [bits // m + (i < bits % m) for i in range(m)]


def _segments(code: Column, widths: list[int]) -> Column:
    """array<struct<segment, value>>"""
    out, at = [], 0
    for i, w in enumerate(widths):
        out.append(F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << w) - 1)).alias("value")))
        at += w
    return F.array(*out)


def search(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the p.k nearest rows of each query, rank from 1. `rows` has vec_id and
    embedding."""
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding"), p.bits).alias("code")).distinct()
    # Spark limits each code's rows before it shuffles them
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= p.k + 1)
    codes = reliable(smallest.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    widths = segment_widths(max(2, codes.count()), p.bits)
    m = len(widths)
    index = reliable(codes.select("code", "ids", F.explode(_segments(F.col("code"), widths)).alias("s")).select("s.*", "code", "ids"))

    open_queries = reliable(rows.where(F.col("id") % p.query_step == 0).select(F.col("id").alias("query_id"), F.col("code").alias("asked")))
    best = spark.createDataFrame([], "query_id long, neighbour_id long, distance int")
    answers = best
    own = Window.partitionBy("query_id")
    for radius in range(max(widths) + 1):
        # masks of `radius` bits for each segment width: at most two widths, sent as literals
        masks = {w: [sum(1 << b for b in c) for c in combinations(range(w), radius)] for w in set(widths)}
        table = spark.createDataFrame([(i, mask) for i, w in enumerate(widths) for mask in masks[w]], "segment int, mask long")
        probes = open_queries.select("query_id", "asked", F.explode(_segments(F.col("asked"), widths)).alias("s")).select("query_id", "asked", "s.*")
        probes = probes.join(table, "segment").select("query_id", "asked", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(index, ["segment", "value"]).select(
            "query_id", F.bit_count(F.col("code").bitwiseXOR(F.col("asked"))).alias("distance"), "ids")
        # ids of one distance are only of use up to the k-th, and a query keeps k
        met = met.select("query_id", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> query_id")
        pool = met.unionByName(best).groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
        ranked = pool.withColumn("rank", F.row_number().over(own.orderBy("distance", "neighbour_id"))).where(F.col("rank") <= p.k)
        ranked = reliable(ranked)
        covered = m * (radius + 1) - 1
        proven = ranked.where((F.col("rank") == p.k) & (F.col("distance") <= covered)).select("query_id")
        if radius == max(widths):
            proven = open_queries.select("query_id").distinct()
        proven = reliable(proven)
        answers = answers.unionByName(ranked.join(proven, "query_id", "left_semi").select("query_id", "neighbour_id", "distance"))
        open_queries = reliable(open_queries.join(proven, "query_id", "left_anti"))
        if open_queries.isEmpty():
            break
        best = ranked.join(proven, "query_id", "left_anti").select("query_id", "neighbour_id", "distance")
    return answers.select("query_id", F.row_number().over(own.orderBy("distance", "neighbour_id")).alias("rank"), "neighbour_id", "distance")
