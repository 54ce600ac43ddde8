"""Quality classifier: random Fourier features of document statistics, ridge scores from partition-summed normal
equations, isotonic calibration.

One pass turns every whole text into a short vector of statistics, which is stored. Standardised statistics go through
random cosines that approximate a Gaussian kernel. Each partition of labelled rows sums its own normal equations; the
sums meet in a few tasks and then on the driver, at a size fixed by `Params`. Ridge scores of labelled rows that were
left out of the fit are counted in fixed bins, pooled to a monotone curve and interpolated.

Results for odd rows: null and empty texts have the statistics of an empty text and are scored. Rows without an id are
scored, not learned from. Repeated rows are scored each. No labels: every score is 0.5. Only doc_id and text are read;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import in_small_batches, reliable
from . import words
from .labelled import held_out, share, text_key, training_labels
from .linear import solve


@dataclass(frozen=True)
class Params:
    features: int = 256
    width: float = 1.0  # of the kernel, times the square root of the number of statistics
    ridge: float = 1e-4  # per labelled row
    calibration: float = 0.25  # share of the training labels that only calibrates
    bins: int = 2000
    summers: int = 8  # tasks in which partitions' sums meet
    seed: int = 1


DEFAULT = Params()

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "short_words", "upper", "capitalised", "digits",
    "stops", "shouts", "symbols", "bars", "not_ascii", "blanks", "controls", "byte_entropy", "distinct_words", "top_word",
    "word_entropy", "repeated_grams", "log_lines", "repeated_lines", "log_line", "odd_ends",
)

_CLASSES = np.zeros((256, 9), dtype=np.float64)
_CLASSES[ord("A") : ord("Z") + 1, 0] = 1
_CLASSES[ord("a") : ord("z") + 1, 1] = 1
_CLASSES[ord("0") : ord("9") + 1, 2] = 1
_CLASSES[[ord(c) for c in ".,;:'\"-()"], 3] = 1
_CLASSES[[ord(c) for c in "!?"], 4] = 1
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[]^_`{}~\\"], 5] = 1
_CLASSES[ord("|"), 6] = 1
_CLASSES[0x80:, 7] = 1
_CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], 8] = 1

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[[0x0A, 0x0D]] = True


def _entropy(counts: np.ndarray) -> float:
    q = counts[counts > 0] / counts.sum()
    return float(-(q * np.log2(q)).sum())


def _repeats(hashes: np.ndarray) -> float:
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """A row of STATISTICS for each text of the column, a slice of rows at a time."""
    plain = words.slices(column, lower=False)
    lines = words.slices(column, separator=_NEWLINE)
    for s, l in zip(plain, lines):
        n = s.last - s.first
        sizes = np.diff(s.offsets)
        owner = np.repeat(np.arange(n), sizes)
        counts = np.bincount(owner * 256 + s.data, minlength=n * 256).reshape(n, 256)
        classes = counts @ _CLASSES
        total = np.maximum(sizes, 1)
        at, line_at = s.word_offsets, l.word_offsets
        n_words = np.diff(at)
        low = words.Slice(s.first, s.last, words.LOWER[s.data], s.offsets, s.starts, s.ends).hashes()
        grams, gram_at = words.windows(low, at, 5, seed=5)
        line_hash = l.hashes()
        lengths = (s.ends - s.starts).astype(np.float64)
        begin, end = s.data[s.starts], s.data[s.ends - 1]
        capital = (begin >= ord("A")) & (begin <= ord("Z"))
        odd = (_CLASSES[end, 4] + _CLASSES[end, 5] + _CLASSES[end, 6]) > 0
        out = np.zeros((n, len(STATISTICS)))
        for i in range(n):
            w = slice(at[i], at[i + 1])
            if not n_words[i]:
                continue
            m, size = n_words[i], lengths[w]
            _, each = np.unique(low[w], return_counts=True)
            out[i, 2:6] = size.mean(), size.std(), (size > 12).mean(), (size <= 3).mean()
            out[i, 7], out[i, 24] = capital[w].mean(), odd[w].mean()
            out[i, 16] = _entropy(counts[i])
            out[i, 17:20] = len(each) / m**0.8, each.max() / m, _entropy(each) / np.log2(m + 1)
            out[i, 20] = _repeats(grams[gram_at[i] : gram_at[i + 1]])
            out[i, 22] = _repeats(line_hash[line_at[i] : line_at[i + 1]])
        out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(n_words)
        out[:, 6] = classes[:, 0] / np.maximum(classes[:, 0] + classes[:, 1], 1)
        out[:, 8:15] = classes[:, 2:9] / total[:, None]
        out[:, 15] = counts[:, :32].sum(axis=1) / total
        n_lines = np.diff(line_at)
        out[:, 21], out[:, 23] = np.log1p(n_lines), np.log1p(n_words / np.maximum(n_lines, 1))
        yield out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for rows in statistics(batch.column("text")):
            part = batch.slice(at, len(rows))
            at += len(rows)
            flat = pa.array(rows.astype(np.float32).ravel(), pa.float32())
            vectors = pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), vectors], names=["doc_id", "text_key", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


class Kernel:
    """Standardising and the random cosines."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, p: Params):
        random = np.random.default_rng(p.seed)
        d = len(STATISTICS)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = random.normal(0, 1 / (p.width * d**0.5), (d, p.features))
        self.shift = random.uniform(0, 2 * np.pi, p.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.cos(z @ self.turn + self.shift) * (2 / len(self.shift)) ** 0.5, np.ones((len(z), 1))], axis=1)


def _equations(kernel: Kernel, p: Params):
    """One row per partition: the sums of z z' and of z y over its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = p.features + 1
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z = kernel(_matrix(batch.column("stats")))
            left += z.T @ z
            right += z.T @ batch.column("y").to_numpy()
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([left.tobytes()]), pa.array([right.tobytes()])],
                                             names=["n", "lhs", "rhs"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of a partition, one row held at a time."""
    n, left, right = 0, 0.0, 0.0
    for batch in batches:
        for i in range(batch.num_rows):
            n += batch.column("n")[i].as_py()
            left = left + np.frombuffer(batch.column("lhs")[i].as_py())
            right = right + np.frombuffer(batch.column("rhs")[i].as_py())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([left.tobytes()]), pa.array([right.tobytes()])],
                                         names=["n", "lhs", "rhs"])


def ridge(rows: DataFrame, kernel: Kernel, p: Params) -> np.ndarray:
    """Weights from all rows (stats, y)."""
    form, size = "n long, lhs binary, rhs binary", p.features + 1
    sums = rows.select("stats", "y").mapInArrow(_equations(kernel, p), form).repartition(p.summers).mapInArrow(_added, form).collect()
    if not sums:
        return np.zeros(size)
    n = sum(r["n"] for r in sums)
    left = sum(np.frombuffer(r["lhs"]) for r in sums).reshape(size, size)
    right = sum(np.frombuffer(r["rhs"]) for r in sums)
    return solve(left + n * p.ridge * np.eye(size), right)


def isotonic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending bins; a monotone curve through the blocks' centres, smoothed by half a
    row of either label so that it stays inside (0, 1)."""
    blocks: list[list[float]] = []
    for place, good, n in zip(x, positive, total):
        blocks.append([place * n, good, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    at = np.array([b[0] / b[2] for b in blocks])
    level = np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))
    return at, level


def _score(kernel: Kernel, weights: np.ndarray, curve: tuple[np.ndarray, np.ndarray] | None):
    """Ridge scores, or calibrated ones if there is a curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch.column("stats"))) @ weights
            if curve is not None:
                at, level = curve
                # beyond the outermost blocks the order of raw scores goes on, squeezed towards 0 and 1
                low, high = level[0] * np.exp(np.minimum(raw - at[0], 0)), 1 - (1 - level[-1]) * np.exp(np.minimum(at[-1] - raw, 0))
                raw = np.where(raw < at[0], low, np.where(raw > at[-1], high, np.interp(raw, at, level)))
            rest = [c for c in batch.schema.names if c != "stats"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(raw, pa.float64())], names=[*rest, "score"])

    return run


@in_small_batches
def classify(docs: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_key."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    stats = reliable(base.mapInArrow(_measure, "doc_id long, text_key binary, stats array<float>"))
    scale = stats.agg(*(f(F.col("stats")[i].cast("double")).alias(f"{name}{i}") for i in range(len(STATISTICS))
                        for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    read = lambda name: np.array([scale[f"{name}{i}"] or 0.0 for i in range(len(STATISTICS))])
    kernel = Kernel(read("m"), read("s"), p)
    known = reliable(stats.join(training_labels(labels, "quality"), "doc_id"))
    fold = share(p.seed) < p.calibration
    weights = ridge(known.where(~fold), kernel, p)

    place = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("score")))
    bins = known.where(fold).select("y", "stats").mapInArrow(_score(kernel, weights, None), "y double, score double").groupBy(
        F.floor(place * (p.bins / 2)).alias("bin")).agg(
        F.sum("y").alias("good"), F.count("*").alias("n"), F.avg(place).alias("x")).orderBy("bin").toPandas()
    if len(bins):
        curve = isotonic(*(bins[c].to_numpy(float) for c in ("x", "good", "n")))
    else:
        curve = np.zeros(1), np.full(1, 0.5)
        weights = np.zeros_like(weights)
    scored = stats.mapInArrow(_score(kernel, weights, curve), "doc_id long, text_key binary, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_key")
