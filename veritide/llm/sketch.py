"""Count-min sketches over 64-bit hashes, merged from partition sketches.

Every input partition counts its hashes in rows of cells and sends its cells on in blocks of 65,536,
or more where the sketch is large, each as gaps of one byte; blocks are summed in parallel. What comes back is, for each of a few thresholds, one bit a
cell: "counted at least so often". A hash whose bit is clear in any row is certain to occur less
often, so a prefilter on the bits loses nothing; collisions only let more pass.

The planes go to every executor. Their size is bounded by MOST_LOG2 (2**30 cells: 128 MB a
threshold). Up to that they grow with the input; past it, more hashes pass and results stay exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.llm.cluster import release, small_batches
from veritide.llm.words import mix, trim

LOW, FLUSH, MOST_LOG2 = 16, 2_500_000, 30


def log2_cells(items: int, per_item: float, most: int = MOST_LOG2) -> int:
    """Cells of the whole sketch, as a power of two, for so many hashes."""
    return min(most, max(LOW + 2, math.ceil(math.log2(max(1, items) * per_item + 1))))


def cells_of(h: np.ndarray, log2: int, depth: int) -> list[np.ndarray]:
    """The cell of each hash in each row; rows follow one another."""
    per_row = log2 - (depth - 1).bit_length()
    out = []
    for row in range(depth):
        own = h if row == 0 else mix(h ^ np.uint64(0xD6E8FEB86659FD93 + row))
        out.append((own >> np.uint64(64 - per_row)).astype(np.int64) + (row << per_row))
    return out


class Planes:
    """Bits by threshold and cell, for lookups in workers."""

    def __init__(self, planes: list[bytes], log2: int, depth: int):
        self.bits = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.log2, self.depth = log2, depth

    def level(self, h: np.ndarray, least: int | None = None) -> np.ndarray:
        """How many thresholds the estimate of each hash reaches."""
        out = np.zeros(len(h), dtype=np.int8)
        cells = cells_of(h, self.log2, self.depth)
        for bits in self.bits[:least]:
            hit = np.ones(len(h), dtype=bool)
            for c in cells:
                hit &= (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
            out += hit
        return out


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of bytes as one binary array."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def gap_bytes(cells: np.ndarray, starts: np.ndarray, bits: int = LOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as bytes, and where each cell's bytes end: the gap to the one before in its block of 1 << bits, 255 for each full 255."""
    low = (cells & np.uint32((1 << bits) - 1)).astype(np.int32)
    gap = np.diff(low, prepend=0)
    gap[starts] = low[starts]
    more, rest = gap // 255, gap % 255
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1], 255, dtype=np.uint8)
    out[ends - 1] = rest
    return out, ends


def gap_cells(data: np.ndarray) -> np.ndarray:
    """The cells, within their block, of gap_bytes()."""
    return np.cumsum(data, dtype=np.int64)[data != 255]


def build(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int, depth: int, thresholds: tuple[int, ...]) -> list[bytes]:
    """The merged planes, one for each threshold (255 at most), of all hashes of all batches of rows.

    A merging task holds a byte a cell: 32 MB. There are 4,096 blocks at most: what a block costs besides its cells is paid for each flush of each task.
    """
    low = max(LOW, log2 - 12)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            few = np.minimum(np.diff(at, append=len(cells)), 255).astype(np.uint8)
            cells = cells[at]
            del at
            block = cells >> low
            edge = np.flatnonzero(np.diff(block)) + 1
            starts = np.concatenate([[0], edge])
            gaps, ends = gap_bytes(cells, starts, low)
            arrays = [binaries(gaps, np.concatenate([[0], ends[np.append(edge, len(cells)) - 1]])), binaries(few, np.append(starts, len(cells)))]
            return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int32)), *arrays], names=["block", "gaps", "counts"])

        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    held += [c.astype(np.uint32) for c in cells_of(h, log2, depth)]
                    size += depth * len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held = []
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, gaps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b not in total:
                    total[b] = np.zeros(1 << low, dtype=np.uint8)
                at = gap_cells(np.frombuffer(gaps.as_buffer(), dtype=np.uint8))
                have = total[b]
                have[at] = np.minimum(have[at].astype(np.uint16) + np.frombuffer(counts.as_buffer(), dtype=np.uint8), 255)
        names = ["block", *[f"p{i}" for i in range(len(thresholds))]]
        found = list(total.items())
        few = max(1, 64 >> low - LOW)
        for at in range(0, len(found), few):
            part = found[at : at + few]
            planes = [[np.packbits(c >= t, bitorder="little").tobytes() for _, c in part] for t in thresholds]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), *[pa.array([x if any(x) else None for x in p], pa.binary()) for p in planes]], names=names)
        del total, found
        trim()

    small_batches(rows.sparkSession)
    parts = rows.mapInArrow(partial, "block int, gaps binary, counts binary").repartition(max(12, 1 << max(log2 - 25, 0)), "block")
    merged = parts.mapInArrow(merge, "block int, " + ", ".join(f"p{i} binary" for i in range(len(thresholds))))
    planes = [bytearray(1 << (log2 - 3)) for _ in thresholds]
    width = 1 << (low - 3)
    for batch in merged.toArrow().to_batches():
        for b, *found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for plane, bits in zip(planes, found, strict=True):
                if bits is not None:
                    plane[b * width : (b + 1) * width] = bits
    del parts, merged
    release(rows.sparkSession)
    whole = []
    while planes:  # one copy at a time
        whole.insert(0, bytes(planes.pop()))
    return whole


def members(ids: DataFrame) -> tuple[list[bytes], int]:
    """A Bloom filter of a bigint column, and its size: the plane of cells counted at all."""
    log2 = log2_cells(ids.count(), 16)

    def own(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    return build(ids, own, log2, 2, (1,)), log2


class Membership:
    """A test of bigints for membership in a one-column frame: surely false, or probably true; null is false.

    The filter is a broadcast of bounded size; ids themselves go nowhere.
    """

    def __init__(self, ids: DataFrame):
        bits, self.log2 = members(ids.where(F.col(ids.columns[0]).isNotNull()))
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    def close(self) -> None:
        """Frees the filter's memory everywhere; for when what it was used in is written."""
        self.bits.destroy()

    def planes(self) -> Planes:
        """For lookups of mixed ids in workers."""
        return Planes(self.bits.value, self.log2, 2)

    def test(self, values: pd.Series) -> pd.Series:
        """For use in workers."""
        h = mix(values.fillna(0).to_numpy(dtype=np.int64).view(np.uint64))
        return pd.Series(self.planes().level(h) > 0) & values.notna().reset_index(drop=True)

    def __call__(self, column: Column | str) -> Column:
        return F.pandas_udf(lambda values: self.test(values), "boolean")(column)


def text_size(rows: DataFrame, column: str = "text") -> int:
    """Bytes of text, to size a sketch by."""
    return int(rows.agg(F.sum(F.octet_length(column))).first()[0] or 0)
