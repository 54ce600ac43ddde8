"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

A column is walked in slices of about `SLICE_BYTES`, so memory follows the slice (or the one longest text) and not
the Arrow batch. Every byte of every text is read; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: ASCII capitals to small letters, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RANDOM = np.random.default_rng(20240613)
_BYTE_CODE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D  # 5 modulo 8, so its powers only repeat after 2^62 steps
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end]; spans ascend and don't overlap. Equal strings hash equal,
    wherever they stand: a prefix sum of byte codes times powers of a base, divided by the power at the start."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        piece = data[base : int(ends[last - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[piece] * _power("up", len(piece)), out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * _power("down", len(piece) + 1)[s]
        first = last
    return mix(out)


@dataclass
class Slice:
    """Some texts of a column: rows first..last, their bytes, where each text begins, and their words."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def word_offsets(self) -> np.ndarray:
        """Where each text's words begin among all words of the slice; one more at the end."""
        return np.searchsorted(self.starts, self.offsets, "left")

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, lower: bool = True, separator: np.ndarray = SPACE) -> Iterator[Slice]:
    """The texts of a string column with their words, about SLICE_BYTES at a time, one text at least."""
    if not len(column):
        return
    data, offsets = _buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        own = offsets[first : last + 1] - offsets[first]
        piece = data[offsets[first] : offsets[last]]
        if lower:
            piece = LOWER[piece]
        inside = ~separator[piece]
        edge = np.empty(len(piece) + 1, bool)
        edge[0], edge[-1] = True, True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[own] = True
        starts = np.flatnonzero(edge[:-1] & inside)
        ends = np.flatnonzero(edge[1:] & inside) + 1
        yield Slice(first, last, piece, own, starts, ends)
        first = last


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside each text, and where each text's windows begin. A text of fewer words,
    but not none, is one window: its whole sequence."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(begins[-1]) - np.repeat(begins[:-1], n) + np.repeat(offsets[:-1], n)
    short = np.repeat(counts < k, n)
    out = np.zeros(begins[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    size = np.repeat(np.minimum(counts, k), n)
    for j in range(k):
        term = padded[place + j] * factors[j]
        if short.any():
            term[j >= size] = 0
        out += term
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begins
