"""Words of a batch of texts as numpy arrays.

The words of all texts of an Arrow column are found on its UTF-8 bytes at once, and
each is given a 64-bit hash: a polynomial over its bytes by prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at once, as far as texts allow.
SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(inside) -> np.ndarray:
    """Truth for each byte value."""
    return np.array([inside(b) for b in range(256)])


#: Words between the six ASCII white-space characters.
SPACED = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of several 64-bit values in order, element by element."""
    out = parts[0].copy()
    for part in parts[1:]:
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + part)
    return out


@dataclass
class Texts:
    """Some texts of a batch: their bytes, and where each begins."""

    first: int  # number of the first text in the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, truth: np.ndarray) -> np.ndarray:
        """How many bytes of each text are true."""
        sums = np.concatenate([[0], np.cumsum(truth, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """Hashes of byte ranges."""
        data = self.data if data is None else data
        up, down = _POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes of a class; none goes beyond its text."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        now = np.zeros(n + 1, dtype=bool)
        now[:n] = inside[self.data]
        was = np.zeros(n + 1, dtype=bool)
        was[1:] = now[:n]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(now & (~was | cut))
        ends = np.flatnonzero(was & (~now | cut))
        return starts, ends

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
        starts, ends = self.spans(inside)
        data = _LOWER[self.data] if lower else self.data
        return Words(self.owner(starts), starts, ends, self.hashes(starts, ends, data), len(self))


@dataclass
class Words:
    """Words in text order: their text, byte range and hash."""

    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    texts: int

    def __len__(self) -> int:
        return len(self.hashes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.texts)

    def firsts(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words of all n-word windows, and the windows' hashes."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.owner[: len(self) - n + 1] == self.owner[n - 1 :])
        return at, chained([self.hashes[at + i] for i in range(n)])


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of a string column, some at a time; null is an empty text.

    A slice holds texts of ``limit`` bytes together, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers, n, at = column.buffers(), len(column), column.offset
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
