"""Sharding by sampled splitters, in DataFrame functions only: shards of near equal bytes.

Records are ordered by the hash of their text, so copies lie next to each other. A size-weighted sample of keys gives
quantile boundaries, and each record finds its range by binary search. The exact bytes of every range are then added
up; a range over `range_bytes`, be it one hot text or just more data than the boundaries foresaw, is subdivided into as
many parts as it needs, by row. A record's shard follows from the bytes before it: those of earlier parts, and of its own part in a
window that is never larger than a part. So shards differ by about one record.

Results for odd rows: a null text has size 16 and the checksum of an empty text. Rows without an id and repeated rows
each have a place of their own. Fewer records than shards leave shards empty, an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import reliable


@dataclass(frozen=True)
class Params:
    shards: int = 40
    overhead: int = 16  # bytes of a record besides its text
    splitters: int = 1023
    sample: int = 65_536  # keys drawn, in expectation
    range_bytes: int = 4 << 20
    seed: int = 4


DEFAULT = Params()


def splitters(records: DataFrame, total: int, p: Params) -> list[int]:
    """Boundaries that cut the bytes of all records into about equal ranges: quantiles of keys drawn with a probability
    that grows with their size."""
    chance = F.col("size") * float(p.sample) / max(1, total)
    drawn = records.select("key", chance.alias("chance")).where(F.rand(p.seed) < F.col("chance"))
    # a record larger than a sample's share of all bytes stands for as many draws as it is worth
    drawn = drawn.select("key", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.sample), F.ceil("chance")).cast("int"))))
    at = [(i + 1) / (p.splitters + 1) for i in range(p.splitters)]
    found = drawn.agg(F.percentile_approx("key", at, 20_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = max(1, len(bounds).bit_length())

    def halve(state: Column, _: Column, b: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        right = F.get(b, middle) <= key
        done = state["low"] >= state["high"]
        return F.struct(F.when(~done & right, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(~done & ~right, middle).otherwise(state["high"]).alias("high"))

    first = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    every = F.array(*(F.lit(b) for b in bounds))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda s, i: halve(s, i, every), lambda s: s["low"])


def shard(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    # the row number is fixed once the table is stored
    records = reliable(docs.select("doc_id", (F.octet_length(text) + p.overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                                   F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")))
    total = records.agg(F.sum("size")).first()[0] or 0
    records = records.withColumn("range", range_of(F.col("key"), splitters(records, total, p)))

    ranges = records.groupBy("range").agg(F.sum("size").alias("bytes"))  # a row per range: splitters + 1 at most
    parts = ranges.select("range", F.greatest(F.lit(1), F.ceil(F.col("bytes") / p.range_bytes)).alias("parts"))
    records = records.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("row", F.lit(p.seed)), F.col("parts")))
    records = reliable(records.select("doc_id", "size", "text_crc32", "key", "row", "range", "part"))

    sums = records.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", "part", "bytes", "rows", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_in_range") for c in ("bytes", "rows")))
    whole = records.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    whole = whole.select("range", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")))
    sums = sums.join(F.broadcast(whole), "range").select("range", "part", (F.col("bytes_in_range") + F.col("bytes_before")).alias("bytes_before"),
                                                         (F.col("rows_in_range") + F.col("rows_before")).alias("rows_before"))

    own = Window.partitionBy("range", "part").orderBy("key", "row")
    placed = records.withColumn("bytes_in", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("rows_in", F.row_number().over(own) - 1).join(sums, ["range", "part"])
    # the shard that holds the record's middle byte
    middle = 2 * (F.col("bytes_before") + F.col("bytes_in")) + F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(p.shards - 1), F.floor(middle * p.shards / (2.0 * max(1, total)))).cast("int"))
    placed = reliable(placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("rows_in")).alias("place")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
