"""Keys, folds and labels that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str | Column) -> Column:
    """Rows kept for evaluation: crc32 of the id as text leaves 1 modulo 3. Rows without an id are not held out, and
    no label can reach them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the labels outside the held-out rows: one row per id, the mean where an id has several."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(~held_out("doc_id"))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(column).cast("double")).alias("y"))


def share(seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone, the same whenever a task is run again."""
    return (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
