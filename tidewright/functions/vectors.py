"""Vector expressions: cosine similarity and the default text embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import WHITESPACE


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


SLOTS = 256


def hashed_ngram_vector(text: Column) -> Column:
    """Counts of words, and at half weight of their character 3-grams with a blank at both ends, hashed into 256 slots."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[^{WHITESPACE}]+"), F.lit(0))
    trigrams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3)))
    grams = F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), trigrams))
    hit = lambda weight: lambda t: F.struct(F.pmod(F.crc32(t), F.lit(SLOTS)).alias("slot"), F.lit(weight).cast("float").alias("weight"))
    empty = F.array_repeat(F.lit(0.0).cast("float"), SLOTS)
    add = lambda v, h: F.transform(v, lambda x, i: F.when(i == h["slot"], x + h["weight"]).otherwise(x))
    return F.aggregate(F.concat(F.transform(words, hit(1.0)), F.transform(grams, hit(0.5))), empty, add)


def embed(df: DataFrame, text: str, into: str) -> DataFrame:
    """Default embedder. Any function of this shape can take its place."""
    return df.withColumn(into, hashed_ngram_vector(F.col(text)))
