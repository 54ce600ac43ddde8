"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text is reduced to the smallest hash of each six consecutive 5-grams. A passage of ten words holds exactly one
such group, so document and benchmark share a fingerprint wherever they share ten words. Fingerprints are joined, hits
are extended to the ten-word windows around them, and these are compared word by word. Benchmark items of fewer than
ten words are one window each and are looked up by the hash of all their words.

A document word is hit if it lies inside any occurrence of a window of any item. Work after the first join is done once
per distinct text, however many copies it has. Which joins broadcast is left to Spark, which knows the sizes of the
stored benchmark tables; common passages are spread by its skew handling.

Results for odd rows: null, empty and wordless texts have no words and no hits. Items without words never match. Rows
without an id and repeated rows get a result each; items with equal ids count once. Items without an id supply windows
and hits as any other, but have no name: they count neither in n_items nor in items_sha256. An empty benchmark leaves
all documents clean. Only doc_id, item_id and text are read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import reliable
from .labelled import text_key


@dataclass(frozen=True)
class Params:
    window: int = 10
    gram: int = 5

    @property
    def group(self) -> int:
        """Grams in a window: the winnowing group that makes every shared window share a fingerprint."""
        return self.window - self.gram + 1


DEFAULT = Params()
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, with its ASCII characters listed: Java looks listed ones up in a table, which
#: takes less than a tenth of the time of the negated ranges.
WORD = r"[0123456789abcdefghijklmnopqrstuvwxyz\x80-\x{10FFFF}]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; nothing for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def text_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; other capitals stay."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def fingerprints(words: Column, p: Params) -> Column:
    """array<struct<print, at>>: the smallest gram hash of every group of grams, and the word where its gram begins. A
    gram is listed again only when it was the smallest and has left the group."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    grams = lambda h: F.transform(upto(F.size(h) - (p.gram - 1)), lambda i: F.xxhash64(*(h[i + k] for k in range(p.gram))))
    least = lambda g: F.transform(upto(F.size(g) - (p.group - 1)), lambda i: F.least(*(g[i + k] for k in range(p.group))))

    def picks(g: Column, m: Column) -> Column:
        fresh = F.filter(upto(F.size(m)), lambda i: (i == 0) | (m[i] != F.get(m, i - 1)) | (F.get(g, i - 1) == F.get(m, i - 1)))
        return F.transform(fresh, lambda i: F.struct(
            m[i].alias("print"), (i + F.array_position(F.slice(g, i + 1, F.lit(p.group)), m[i]).cast("int") - 1).alias("at")))

    return let(hashes(words), lambda h: let(grams(h), lambda g: let(least(g), lambda m: picks(g, m))))


def short_windows(words: Column, length: int) -> Column:
    """array<struct<print, at>>: the hash of all `length` consecutive words, everywhere."""
    return let(words, lambda w: F.transform(upto(F.size(w) - (length - 1)), lambda i: F.struct(
        F.xxhash64(F.slice(w, i + 1, F.lit(length))).alias("print"), i.alias("at"))))


def item_windows(items: DataFrame, p: Params) -> DataFrame:
    """(item_id, length, window): the distinct windows of every item, the words joined by blanks."""
    words = items.select("item_id", text_words(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(p.window))
    words = words.withColumn("length", length)
    starts = words.select("item_id", "words", "length", F.explode(upto(F.size("words") - F.col("length") + 1)).alias("at"))
    return starts.select("item_id", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", text_key(F.col("text")))
    items = items.select("item_id", "text")
    windows = reliable(item_windows(items, p))
    known = windows.groupBy("window", "length").agg(F.collect_set("item_id").alias("items"))  # no entry for items without an id
    known = reliable(known)

    found = items.select(F.explode(fingerprints(text_words(F.col("text")), p)).alias("f")).select("f.print").distinct()
    found = reliable(found)
    spots = keyed.select("text_key", F.explode(fingerprints(text_words(F.col("text")), p)).alias("f")).select("text_key", "f.*")
    # the windows that hold a hit gram: those that begin up to `group` - 1 words before it
    spots = spots.join(found, "print").select(
        "text_key", F.lit(p.window).alias("length"), F.explode(F.sequence(F.greatest(F.col("at") - (p.group - 1), F.lit(0)), "at")).alias("at"))
    for row in windows.where(F.col("length") < p.window).select("length").distinct().collect():  # at most window - 1 rows
        n = row["length"]
        short = reliable(windows.where(F.col("length") == n).select(F.xxhash64(F.split("window", " ")).alias("print")).distinct())
        there = keyed.select("text_key", F.explode(short_windows(text_words(F.col("text")), n)).alias("f")).select("text_key", "f.*")
        spots = spots.union(there.join(short, "print").select("text_key", F.lit(n).alias("length"), "at"))
    spots = reliable(spots.distinct().groupBy("text_key").agg(F.collect_list(F.struct("length", "at")).alias("spots")))

    # the list of texts with hits grows with the corpus: it is never broadcast
    once = keyed.select("text_key", "text").join(spots.select("text_key").hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    near = once.join(spots, "text_key").select("text_key", text_words(F.col("text")).alias("words"), "spots")
    near = near.select("text_key", "words", F.explode("spots").alias("s")).where("s.at + s.length <= size(words)")
    near = near.select("text_key", "s.length", "s.at", F.array_join(F.slice("words", F.col("s.at") + 1, F.col("s.length")), " ").alias("window"))
    hits = reliable(near.join(known, ["window", "length"]).select("text_key", "length", "at", "items"))

    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    spans = hits.groupBy("text_key").agg(F.collect_set(F.struct("at", "length")).alias("spans")).select("text_key", covered.cast("long").alias("n_hit"))
    named = hits.select("text_key", F.explode("items").alias("item_id")).distinct().groupBy("text_key").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("names"))
    named = named.select("text_key", F.size("names").cast("long").alias("n_items"), F.array_join(F.array_sort("names"), ",").alias("names"))
    out = keyed.select("doc_id", "text_key", F.size(text_words(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(spans.join(named, "text_key", "left"), "text_key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "text_key")
