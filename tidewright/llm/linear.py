"""Small dense linear algebra for the driver in element-wise numpy only.

A threaded BLAS may never return in a process that has forked since its threads started, as a driver has that launched
its JVM. Nothing here calls BLAS or LAPACK. The matrices are at most a few hundred rows wide, whatever the data.
"""

from __future__ import annotations

import numpy as np


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b."""
    return np.einsum("ij,jk->ik", a, b, optimize=False)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b, by elimination with partial pivoting; a is real or complex, b a vector or a matrix."""
    n = len(a)
    kind = np.result_type(a, b, np.float64)
    left, right = a.astype(kind), b.astype(kind).reshape(n, -1)
    for k in range(n):
        pivot = k + int(np.abs(left[k:, k]).argmax())
        if left[pivot, k] == 0:
            raise ZeroDivisionError("singular matrix")
        if pivot != k:
            left[[k, pivot]], right[[k, pivot]] = left[[pivot, k]], right[[pivot, k]]
        factor = left[k + 1 :, k] / left[k, k]
        left[k + 1 :, k:] -= factor[:, None] * left[k, k:]
        right[k + 1 :] -= factor[:, None] * right[k]
    for k in reversed(range(n)):
        right[k] /= left[k, k]
        right[:k] -= left[:k, k, None] * right[k]
    return right.reshape(b.shape)


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of `a`, by Gram-Schmidt run twice; columns that depend on earlier ones go."""
    kept: list[np.ndarray] = []
    scale = np.sqrt((a * a).sum(axis=0)).max(initial=0.0)
    for column in a.T:
        v = column.copy()
        for _ in range(2):
            for q in kept:
                v -= (q * v).sum() * q
        size = np.sqrt((v * v).sum())
        if size > 1e-13 * scale:
            kept.append(v / size)
    return np.array(kept).T.reshape(len(a), len(kept))


def symmetric(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix, by Jacobi rotations."""
    a, n = a.astype(float).copy(), len(a)
    vectors = np.eye(n)
    for _ in range(sweeps):
        if n < 2 or np.abs(np.triu(a, 1)).max() <= 1e-300 + 1e-17 * np.abs(np.diag(a)).max():
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] == 0 or abs(a[p, q]) <= 1e-18 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (a, vectors):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
                a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed `shift`: the inertia of a - shift I, from the signs of the
    blocks of a pivoted L D L^T (Bunch-Parlett: single pivots, or two at once where the diagonal is small)."""
    m, n = a.astype(float) - shift * np.eye(len(a)), len(a)
    positive, k = 0, 0
    scale = max(np.abs(a).max(initial=0.0), abs(shift), 1e-300)
    while k < n:
        rest = m[k:, k:]
        on = int(np.abs(np.diag(rest)).argmax())
        off = np.abs(rest - np.diag(np.diag(rest)))
        i, j = divmod(int(off.argmax()), n - k)
        if abs(rest[on, on]) >= 0.6403882032 * off[i, j]:
            _swap(rest, 0, on)
            d = rest[0, 0]
            if abs(d) <= 1e-300 * scale:
                return positive  # all that is left is zero: those eigenvalues equal the shift
            positive += d > 0
            rest[1:, 1:] -= np.multiply.outer(rest[1:, 0], rest[0, 1:]) / d
            k += 1
        else:
            i, j = min(i, j), max(i, j)
            _swap(rest, 0, i)
            _swap(rest, 1, j)
            positive += 1  # such a block has one eigenvalue of each sign
            (p, q), (_, r) = rest[:2, :2]
            det = p * r - q * q
            u, v = rest[2:, 0].copy(), rest[2:, 1].copy()
            rest[2:, 2:] -= (np.multiply.outer(r * u - q * v, u) + np.multiply.outer(p * v - q * u, v)) / det
            k += 2
    return positive


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]
