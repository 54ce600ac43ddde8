"""Whitening of embeddings; the components come from FEAST contour integration.

Vectors are rounded down to whole 256ths. The fit list holds each distinct vector once; its size, exact sums and
covariance are added up per partition, then over a fixed number of tasks, and only one matrix per such task comes to the
driver, dimension x dimension, whatever the number of rows.

On the driver, counts of the eigenvalues above a shift (the inertia of the shifted covariance) bracket the largest
eigenvalues and cut their range into intervals where gaps are. For each interval the spectral projector is a contour
integral around it: complex shifted systems are solved at the quadrature points of a half circle, which filters a block
of vectors; Rayleigh-Ritz on the filtered block gives the components, and rounds repeat until the residuals are at the
level of rounding. An interval counts as done only when it yields as many components as its two inertia counts demand;
otherwise the block is widened, at most to the whole space. Linear algebra is that of `linear`.

Results for odd rows: null vectors and those with null, NaN or infinite entries are dropped. Shorter vectors count as
zero beyond their end; entries beyond 2^53 256ths are held there. Rows without an id and repeated rows get their results;
copies count once in the fit list. Directions without variance have no whitened value and are left out, so fewer than
`components` components may exist; one distinct vector, only empty vectors, or an empty table give an empty result. A
deviation that no long can hold is null. Tied eigenvalues: any orthonormal components, the same for all rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import reliable
from .linear import above, orthonormal, product, solve, symmetric

LARGEST = 2.0**53


@dataclass(frozen=True)
class Params:
    components: int = 4
    scale: float = 256.0
    nodes: int = 8  # quadrature points on the half circle
    rounds: int = 80
    cut: float = 0.1  # relative gap at which an interval ends
    apart: float = 1e-3  # relative gap below which the last interval takes one more eigenvalue
    summers: int = 8
    seed: int = 11


DEFAULT = Params()


def rounded(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(vec_id, x): the vectors that have only finite entries, in whole 1/scale; stored, all of one length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * p.scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    rows = reliable(rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", whole.alias("x")))
    sizes = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes["most"] and sizes["least"] < sizes["most"]:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(sizes["most"]) - F.size("x"))))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


SUMS = "n long, whole array<string>, parts binary"


def _partial(of: Callable[[np.ndarray], tuple[list[int], np.ndarray]]):
    """Per partition: number of rows, exact whole sums, floating sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole, parts = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                for i in range(0, len(x), 8192):
                    w, q = of(x[i : i + 8192])
                    n, whole, parts = n + len(x[i : i + 8192]), w if whole is None else [a + b for a, b in zip(whole, w)], q if parts is None else parts + q
        if n:
            yield _row(n, whole, parts)

    return run


def _row(n: int, whole: list[int], parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(w) for w in whole]], pa.list_(pa.string())), pa.array([parts.tobytes()], pa.binary())],
                                      names=["n", "whole", "parts"])


def _unpack(n, whole, parts) -> tuple[int, list[int], np.ndarray]:
    return n, [int(w) for w in whole], np.frombuffer(parts)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, whole, parts = 0, None, None
    for batch in batches:
        for r in batch.to_pylist():
            m, w, q = _unpack(**r)
            n, whole, parts = n + m, w if whole is None else [a + b for a, b in zip(whole, w)], q if parts is None else parts + q
    if n:
        yield _row(n, whole, parts)


def _total(rows: DataFrame, of: Callable, p: Params) -> tuple[int, list[int], np.ndarray]:
    """The sums over all rows; one record per task of the last step, at most `summers`, comes to the driver."""
    found = rows.select("x").mapInArrow(_partial(of), SUMS).repartition(p.summers).mapInArrow(_joined, SUMS).collect()
    found = [_unpack(*r) for r in found]
    return sum(r[0] for r in found), [sum(w) for w in zip(*(r[1] for r in found))], sum(r[2] for r in found)


def _sums(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    if len(x) * float(np.abs(x.astype(float)).max(initial=0)) < 2.0**62:
        return x.sum(axis=0).tolist(), np.zeros(0)
    return [sum(c) for c in zip(*x.tolist())], np.zeros(0)


def _scatter(mean: np.ndarray):
    def of(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        centred = x - mean
        return [], centred.T @ centred

    return of


def _whitened_scatter(mean: np.ndarray, axes: np.ndarray):
    """Sums and products of whitened values, side by side: the first column holds the sums."""
    def of(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        w = (x - mean) @ axes
        return [], np.column_stack([w.sum(axis=0), w.T @ w])

    return of


def intervals(v: np.ndarray, k: int, p: Params) -> tuple[int, list[tuple[float, float, int]]]:
    """(k, [(low, high, eigenvalues inside)]): intervals, from the top, that hold the k largest eigenvalues, with their
    ends in gaps; k shrinks to the number of eigenvalues that rounding can tell from zero."""
    d, trace = len(v), float(np.trace(v))
    least = 4 * d * np.finfo(float).eps * trace
    exist = above(v, least) if trace > 0 else 0
    k = min(k, exist)
    if not k:
        return 0, []
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6)
    counted: dict[float, int] = {least: exist, top: 0}

    def locate(j: int) -> float:
        """The j-th largest eigenvalue, to a relative 1e-5, from the counts made so far and new ones."""
        low = max(s for s, n in counted.items() if n >= j)
        high = min(s for s, n in counted.items() if n < j)
        while high - low > 1e-5 * high:
            middle = (low + high) / 2 if high < 4 * low else (low * high) ** 0.5
            counted[middle] = above(v, middle)
            low, high = (middle, high) if counted[middle] >= j else (low, middle)
        return (low + high) / 2

    values = [locate(j + 1) for j in range(min(k + 1, exist))]
    while len(values) > k and len(values) < exist and values[-2] - values[-1] < p.apart * values[-2]:
        values.append(locate(len(values) + 1))
    m = len(values) - 1 if len(values) > k and values[-2] - values[-1] >= p.apart * values[-2] else len(values)
    after = values[m] if m < len(values) else least
    out, first = [], 0
    for i in range(m):
        following = values[i + 1] if i + 1 < m else after
        if i + 1 == m or values[i] - following > p.cut * values[i]:
            low, high = (values[i] + following) / 2, values[first] * (1 + p.cut / 2)
            out.append((low, high, above(v, low) - above(v, high)))
            first = i + 1
    if sum(count for *_, count in out) != above(v, out[-1][0]):
        raise ArithmeticError("an eigenvalue lies between the intervals")
    return k, out


def contour(v: np.ndarray, low: float, high: float, count: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues inside (low, high), falling, and their unit vectors in columns."""
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    angles = np.pi * (np.arange(p.nodes) + 0.5) / p.nodes
    size = float(np.abs(v).sum(axis=1).max())
    width = min(d, count + max(4, count // 2))
    while True:
        block = np.random.default_rng(p.seed).normal(size=(d, width))
        best = np.inf
        for _ in range(p.rounds):
            filtered = np.zeros_like(block)
            for angle in angles:
                turn = np.exp(1j * angle)
                shifted = (centre + radius * turn) * np.eye(d) - v
                filtered += (radius * turn * solve(shifted, block)).real / p.nodes
            basis = orthonormal(filtered)
            values, turned = symmetric(product(product(basis.T, v), basis))
            vectors = product(basis, turned)
            inside = (values > low) & (values < high)
            rest = np.abs(product(v, vectors) - vectors * values)[:, inside].max(initial=0.0) / size
            if inside.sum() == count and (rest < 1e-15 or (rest < 1e-13 and rest > best / 2)):
                return values[inside], vectors[:, inside]
            best, block = min(best, rest) if inside.sum() == count else np.inf, vectors
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues counted between {low} and {high}, found {int(inside.sum())}, residual {rest}")
        width = min(d, 2 * width)


def feast(v: np.ndarray, k: int, p: Params = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit vectors; fewer if fewer differ from zero."""
    k, parts = intervals(v, k, p)
    found = [contour(v, low, high, count, p) for low, high, count in parts]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    vectors = orthonormal(vectors)  # across intervals; inside one they are already
    return values, vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0))


FORM = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    k = len(explained)

    def deviations(x: np.ndarray) -> pa.Array:
        most = n * float(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in sums)
        if most * most * x.shape[1] < 2.0**62:
            off = n * x - np.array(sums, np.int64)
            return pa.array((off * off).sum(axis=1))
        exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            columns = {
                "vec_id": batch.column("vec_id").take(again), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(again), n)), "deviation": deviations(x).take(again), "whitened": pa.array(((x - mean) @ axes).reshape(-1)),
                "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(len(again), error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def whiten(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(rows.select("vec_id").dtypes)["vec_id"]
    rows = rounded(rows, p)
    fit = reliable(rows.select("x").distinct())
    n, sums, _ = _total(fit, _sums, p)
    if not n or not sums:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {FORM}")
    d, mean = len(sums), np.array([s / n for s in sums])
    v = np.asarray(_total(fit, _scatter(mean), p)[2]).reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = feast(v, p.components, p)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {FORM}")
    axes = vectors / np.sqrt(values)
    seen = np.asarray(_total(fit, _whitened_scatter(mean, axes), p)[2]).reshape(k, k + 1) / n
    error = float(np.abs(seen[:, 1:] - np.multiply.outer(seen[:, 0], seen[:, 0]) - np.eye(k)).max())
    return rows.mapInArrow(_project(n, sums, mean, axes, values / float(np.trace(v)), error), f"vec_id {kind}, {FORM}")
