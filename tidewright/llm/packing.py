"""Packing: documents into sequences of a fixed number of tokens as a cutting-stock problem.

One pass tokenizes every whole text and cuts what is longer than a sequence into full pieces and a rest; no other text
is cut. The histogram of piece lengths, in a fixed number of classes, goes to the driver. Column generation solves the
linear program over packing patterns there: a dynamic program over the knapsack prices new patterns with the program's
duals until no pattern can save more than `gap`. Patterns are rounded down, what is left over is packed first-fit by
class. Every piece has a rank inside its class, found without sorting the table, and takes the pattern slot of that
rank. Lengths are rounded up to their class only for planning, which costs about 0.3 % of padding.

Results for odd rows: null and empty texts are one piece, the closing id alone. Rows without an id and repeated rows
are packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import reliable
from . import words
from .linear import inverse

SLICE_BYTES = words.SLICE_BYTES


@dataclass(frozen=True)
class Params:
    length: int = 4096
    closing_id: int = 2
    tokenizer: str | None = None  # path of a tokenizer file; None: the installed word_bpe_49k.json
    cached_words: int = 2_000_000  # per Python worker
    gap: float = 5e-4
    bucket_rows: int = 5_000  # rows of a class that are ranked together

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


DEFAULT = Params()
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and never merges across it: a text's ids are those of
    its blank-separated chunks. Chunks are encoded once and found again by hash, up to a bounded number."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def encode(self, s: words.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, end to end, and where each text's begin (one more at the end)."""
        found, first, back = np.unique(s.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > max(self.most, len(found)):
            self.clear()
        place = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == found[inside]
        new = np.flatnonzero(~known)
        if len(new):
            chunks = [s.word_bytes(i).decode("utf-8", "replace") for i in first[new]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            begins = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.flat = np.concatenate([self.flat, np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum()))])
            at = place[new]
            self.keys, self.begins, self.sizes = np.insert(self.keys, at, found[new]), np.insert(self.begins, at, begins), np.insert(self.sizes, at, sizes)
            place = np.searchsorted(self.keys, found)
        word = place[back]
        sizes = self.sizes[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begins[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[s.word_offsets]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, most: int) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, most)
    return _encoders[path]


def _cut(p: Params):
    path = p.path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.uint32(p.closing_id).astype("<u4").tobytes()
        coder = encoder(path, p.cached_words)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for s in words.slices(batch.column("text"), lower=False):
                ids, at = coder.encode(s)
                data = memoryview(ids.astype("<u4").tobytes())
                owner, rows = [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    total = b - a + 1
                    for start in range(0, total, p.length):
                        size = min(p.length, total - start)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * min(a + start + size, b)])
                        if start + size == total:
                            crc = zlib.crc32(closing, crc)
                        owner.append(s.first + i)
                        rows.append((start, size, crc, total))
                columns = np.array(rows, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(owner, pa.int64())), *(pa.array(c) for c in columns)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def size_class(length: Column, p: Params) -> Column:
    """Lengths up to a quarter of a sequence in steps of 1/1024 of it, up to a half in steps of 1/512, then 1/256."""
    unit = max(1, p.length // 1024)
    step = lambda n: F.ceil(length / (n * unit)) * (n * unit)
    return F.least(F.lit(p.length).cast("long"), F.when(length <= p.length // 4, step(1)).when(length <= p.length // 2, step(2)).otherwise(step(4)))


class _Program:
    """min sum x, pattern counts x >= 0 that cover the demand of every size class."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int):
        self.sizes, self.demand, self.capacity = sizes, demand.astype(float), capacity
        self.columns, self.x = self._first_fit()
        self.inverse = inverse(self.columns)

    def _first_fit(self) -> tuple[np.ndarray, np.ndarray]:
        """A first basis: fill a sequence from the largest size down and repeat that pattern until a size runs out. A
        later pattern never holds that size, so the patterns are independent."""
        columns, x = np.diag((self.capacity // self.sizes).astype(float)), np.zeros(len(self.sizes))
        left = self.demand.copy()
        while (left > 0).any():
            a, room = np.zeros(len(self.sizes)), self.capacity
            for i in np.flatnonzero(left > 0)[::-1]:
                n = min(room // self.sizes[i], max(1, int(left[i])))
                a[i], room = n, room - n * self.sizes[i]
            held = a > 0
            ratio = np.where(held, left / np.where(held, a, 1), np.inf)
            out = int(ratio.argmin())
            columns[:, out], x[out] = a, ratio[out]
            left = np.maximum(left - ratio[out] * a, 0)
            left[held & (left < 1e-9)] = 0
        return columns, x

    def duals(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def price(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per capacity the dearest filling, and the last size class put in (or -1)."""
        best, last = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        upto = np.searchsorted(self.sizes, np.arange(self.capacity + 1), "right")
        for c in range(1, self.capacity + 1):
            n = upto[c]
            best[c], last[c] = best[c - 1], -1
            if n:
                value = best[c - self.sizes[:n]] + y[:n]
                i = int(value.argmax())
                if value[i] > best[c] + 1e-12:
                    best[c], last[c] = value[i], i
        return best, last

    def pattern(self, last: np.ndarray, first: int) -> np.ndarray:
        """The dearest pattern that has one piece of the class `first`."""
        a = np.zeros(len(self.sizes))
        a[first] = 1
        c = self.capacity - self.sizes[first]
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                a[last[c]] += 1
                c -= self.sizes[last[c]]
        return a

    def enter(self, a: np.ndarray) -> None:
        held = np.flatnonzero(a)
        d = (self.inverse[:, held] * a[held]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, self.x / d, np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            return
        self.x = np.maximum(self.x - ratio[r] * d, 0)
        self.x[r] = ratio[r]
        pivot = self.inverse[r] / d[r]
        self.inverse -= np.outer(d, pivot)
        self.inverse[r] = pivot
        self.columns[:, r] = a

    def solve(self, gap: float, most: int = 150) -> None:
        """Column generation. Duals over the dearest pattern's price are feasible, which bounds what is left to gain;
        so does the volume."""
        bound = self.sizes @ self.demand / self.capacity
        for _ in range(most):
            y = self.duals()
            best, last = self.price(y)
            bound = max(bound, y @ self.demand / max(1.0, best[-1]))
            if self.x.sum() <= (1 + gap) * bound:
                return
            worth = y + best[self.capacity - self.sizes]
            for first in np.argsort(-worth)[:60]:
                a = self.pattern(last, int(first))
                if self.duals() @ a > 1 + 1e-9:
                    self.enter(a)


def plan(histogram: dict[int, int], p: Params) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((class, pieces), ...) with the number of sequences that use each; together they hold every piece."""
    unit = max(1, p.length // 1024)
    capacity = p.length // unit
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()])
    units = -(-sizes // unit)
    program = _Program(units, demand, capacity)
    program.solve(p.gap)
    left = demand.copy()
    uses: Counter = Counter()
    for j in np.argsort(-program.x):
        a = np.rint(program.columns[:, j]).astype(int)
        held = a > 0
        n = int(min(np.floor(program.x[j] + 1e-9), (left[held] // a[held]).min()))
        if n > 0:
            left -= n * a
            uses[tuple((int(sizes[i]), int(a[i])) for i in np.flatnonzero(held))] += n
    bins: list[list] = []  # what rounding left over: at most a few pieces per class and pattern, first-fit from large to small
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            for b in bins:
                if b[0] >= units[i]:
                    break
            else:
                bins.append(b := [capacity, Counter()])
            b[0] -= units[i]
            b[1][int(sizes[i])] += 1
    for _, held in bins:
        uses[tuple(sorted(held.items()))] += 1
    return list(uses.items())


def pieces(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """All pieces of all documents, stored, with a row number of their own."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reliable(base.mapInArrow(_cut(p), PIECE).withColumn("piece", F.monotonically_increasing_id()))


def pack(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = pieces(docs, p).withColumn("class", size_class(F.col("length"), p))
    histogram = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}
    slots, sequence = [], 0
    ranks: Counter = Counter()
    for held, uses in plan(histogram, p) if histogram else []:
        for place, (size, n) in enumerate(held):
            slots.append((size, ranks[size], ranks[size] + n * uses, sequence, n, place))
            ranks[size] += n * uses
        sequence += uses
    # as many rows as patterns have classes: bounded by the number of classes, however many pieces there are
    slots = spark.createDataFrame(slots, "class long, lowest long, beyond long, sequence long, pieces long, place int")

    buckets = max(1, -(-sum(histogram.values()) // p.bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    counted = cut.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("class", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("piece")) - 1)
    ranked = ranked.join(counted, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    slot = F.col("rank") - F.col("lowest")
    placed = ranked.join(F.broadcast(slots), "class").where("rank >= lowest and rank < beyond").withColumn(
        "sequence_id", F.col("sequence") + F.floor(slot / F.col("pieces")))
    inside = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
