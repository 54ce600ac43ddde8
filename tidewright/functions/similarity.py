"""String similarity the JVM functions lack, as Arrow-batched column functions.

All three work on whole batches of pairs. They are called on pairs that a join
has already narrowed down, never on a product of two large tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the characters of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * (1 - (total - 2 * lcs_length(a, b)) / total)


def token_set_score(a: str, b: str) -> float:
    """Best indel ratio among shared words and shared words plus either rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    rest_a = " ".join(sorted(left - right))
    rest_b = " ".join(sorted(right - left))
    if shared and (not rest_a or not rest_b):
        return 100.0
    with_a = f"{shared} {rest_a}".strip()
    with_b = f"{shared} {rest_b}".strip()
    scores = [indel_ratio(with_a, with_b)]
    if shared:
        scores += [indel_ratio(shared, with_a), indel_ratio(shared, with_b)]
    return max(scores)


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)])


def _byte_matrix(texts: pd.Series, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    encoded = [t.encode("utf-8") for t in texts]
    lengths = np.fromiter((len(e) for e in encoded), dtype=np.int64, count=len(encoded))
    packed = b"".join(e.ljust(width, b"\0") for e in encoded)
    matrix = np.frombuffer(packed, dtype=np.uint8).reshape(len(encoded), width).astype(np.int16)
    matrix[np.arange(width)[None, :] >= lengths[:, None]] = pad
    return matrix, lengths


def jaro_winkler_batch(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler over UTF-8 bytes, the loops vectorised across the batch.

    The common-prefix bonus (0.1 per byte, four at most) counts only above a
    Jaro score of 0.7; empty text scores 0.
    """
    if len(a) == 0:
        return np.zeros(0)
    width = max(1, max(max(len(t.encode("utf-8")) for t in s) for s in (a, b)))
    left, len_a = _byte_matrix(a, width, -1)
    right, len_b = _byte_matrix(b, width, -2)
    rows = np.arange(len(left))
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    used = np.zeros(left.shape, dtype=bool)
    matched_a = np.zeros(left.shape, dtype=bool)
    columns = np.arange(width)[None, :]
    for i in range(width):
        free = (right == left[:, i:i + 1]) & ~used & (np.abs(columns - i) <= reach[:, None])
        first = free.argmax(axis=1)
        hit = free[rows, first]
        used[rows[hit], first[hit]] = True
        matched_a[:, i] = hit
    matches = matched_a.sum(axis=1)
    # matched characters of each side, moved to the front in their own order
    order_a = np.argsort(~matched_a, axis=1, kind="stable")
    order_b = np.argsort(~used, axis=1, kind="stable")
    seq_a = np.take_along_axis(left, order_a, axis=1)
    seq_b = np.take_along_axis(right, order_b, axis=1)
    differing = ((seq_a != seq_b) & (columns < matches[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(
            matches > 0,
            (matches / len_a + matches / len_b + (matches - differing // 2) / matches) / 3.0,
            0.0,
        )
    same = left[:, :4] == right[:, :4]
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1.0 - jaro), jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    step = 4096
    for a, b in batches:
        parts = [jaro_winkler_batch(a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
        yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
