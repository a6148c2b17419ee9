"""Words, word windows and their hashes for whole Arrow batches, without a Python loop over words.

A word is a run of characters other than space, tab, LF, VT, FF and CR. These six are single
bytes in UTF-8 and part of no longer character, so the scan works on bytes. Word hashes are
polynomials modulo 2**64, taken from prefix sums and then mixed; window hashes are polynomials
over the mixed word hashes. Two independent bases give 128 bits where identity matters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def sums(values: np.ndarray, base: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[first:last] for every pair of bounds."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[last] - total[first]) * down[first]


class Words:
    """The words of some texts: byte bounds in data, the row of each, and hashes on demand."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.string()).fill_null("")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~SPACE[data]
        breaks = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]
        opens = inside[1:-1] & ~inside[:-2]
        opens[breaks] = inside[1:-1][breaks]
        closes = inside[1:-1] & ~inside[2:]
        closes[breaks - 1] = inside[1:-1][breaks - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.rows = len(texts)
        #: words of row i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self._hash: dict[int, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        if which not in self._hash:
            base = BASES[which]
            self._hash[which] = mix(sums(self.data.astype(np.uint64) + np.uint64(1), base, self.start, self.end))
        return self._hash[which]

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of k words within one row."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - k + 1)
        at = at[self.row[at] == self.row[at + k - 1]]
        return at, mix(sums(self.hashes(which), BASES[1 - which], at, at + k))

    def joined(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a row, or those that keep marks, joined by one space."""
        lo, hi = self.first[row], self.first[row + 1]
        words = bytes(self.data[self.offsets[row] : self.offsets[row + 1]]).split()
        assert len(words) == hi - lo
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep, strict=True) if k])


def trim() -> None:
    """Gives freed memory back to the system at the end of a task: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about this many bytes of text, one row at least, so that scratch arrays stay small."""
    texts = batch.column(batch.schema.get_field_index(column))
    size = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
    at = 0
    upto = np.cumsum(size, dtype=np.int64)
    while at < len(size):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
