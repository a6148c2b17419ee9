"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find.

A line's set is its SHINGLE-character shingles; a shorter line is one shingle, so only copies match it. One-permutation
MinHashes, with rotation for empty cells, give the minima; a band takes one cell of each of its rows, and the bands are a
line's keys. Rows of short lines are hashed apart, so that the minima of a band are of different shingles; those of long lines,
with shingles enough for all cells, come from one pass. Lines of up to 30 shingles have 12 bands of 4 minima, others 24 of 6
(few chance matches, which grow with the square of the lines), by one of three kinds of passes; lines that are near the
bound of a kind have both: two lines at the threshold of PERCENT / 100 differ in size by a fifth at most, so they always have a
kind of bands in common. At the threshold two lines share a key with probability over 0.998 (0.993 measured
on lines of 13 characters), above it more. Keys are joined by sorting, in one pass over the texts; lines that share none go no
further. The others meet in the regions of pivots, the least ids that their keys have, first by bitmaps of
their shingles, which rule out most chance meetings and no link, then, with their texts, for exact
Jaccard tests (space.py, as for the n-gram join), which give links; union-find makes components of them, and of
each component the line of the smallest (document, place) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm import sketch
from veritide.llm.cluster import cut, partitions, release, small_batches, spread_join, stored
from veritide.llm.quality import let
from veritide.llm.space import class_of_points, grouped
from veritide.llm.words import mix, slices, sums, trim

SHINGLE, PERCENT, MIN_CHARS = 5, 80, 1
#: least and most shingles of a line, minima a band, bands, passes over the shingles; neighbours overlap by the threshold
KINDS = ((1, 30, 4, 12, 4), (24, 75, 6, 24, 6), (60, 200, 6, 24, 3), (160, 1 << 40, 6, 24, 1))
SLICE, FLUSH, PER_BUCKET = 400_000, 1_500_000, 250
ID_BITS, MASK = 48, np.uint64((1 << 48) - 1)
MARK_BITS = 512  # a power of two
EMPTY = np.uint32(0xFFFFFFFF)
WIDE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SCHEMA = "id bigint, f1 bigint, f2 bigint, mark binary, size int, payload binary, doc_id bigint, line int"


def windows(codes: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """For every place a polynomial of the SHINGLE = 5 code points from there on (the last few are void): sums over 2 and 4 neighbours, and the fifth."""
    one = codes + codes.dtype.type(1)
    h = one
    for step, factor in enumerate(factors[:2]):
        wide = 1 << step
        more = h * codes.dtype.type(factor)
        more[:-wide] += h[wide:]
        h = more
    h = h * codes.dtype.type(factors[2])
    h[:-4] += one[4:]
    return h


def shingles(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash for every place of codes, of the shingle that starts there."""
    h = windows(codes, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def short_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of whole lines that are shorter than a shingle."""
    place = start[:, None] + np.arange(SHINGLE)
    held = np.where(place < end[:, None], codes[np.minimum(place, len(codes) - 1)] + np.uint32(1), np.uint32(0)).astype(np.uint64)
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + held[:, k])
    return (out >> np.uint64(32)).astype(np.uint32)


def line_set(payload: bytes) -> np.ndarray:
    """The sorted 64-bit shingle hashes of one line."""
    codes = np.frombuffer(payload.decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = mix(windows(codes, WIDE)[: max(1, len(codes) - SHINGLE + 1)])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def line_sets(payloads: list[bytes]) -> list[np.ndarray]:
    """line_set() of each, hashed together."""
    texts = [p.decode() for p in payloads]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h, at, out = mix(windows(codes, WIDE)) if len(codes) else codes, 0, []
    for text, payload in zip(texts, payloads, strict=True):
        n = len(text)
        if n < SHINGLE:
            out.append(line_set(payload))
        else:
            own = h[at : at + n - SHINGLE + 1]
            own.sort()
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.append(True, fresh)])
        at += n
    return out


line_set.many = line_sets


class Lines:
    """The judged lines of some texts: all with a word in them (MIN_CHARS code points or more, which is one)."""

    def __init__(self, texts: pa.Array):
        values = [t or "" for t in texts.to_pylist()]
        self.codes = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le"), dtype=np.uint32)
        end = np.flatnonzero(self.codes == 10)
        start = np.append(0, end[:-1] + 1) if len(end) else end
        per_doc = np.array([t.count("\n") + 1 for t in values], dtype=np.int64)
        doc = np.repeat(np.arange(len(values)), per_doc)
        place = np.arange(len(start)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        word = np.logical_or.reduceat((self.codes != 32) & (self.codes - np.uint32(9) > 4), start) if len(start) else np.zeros(0, bool)
        judged = (end - start >= MIN_CHARS) & word
        self.start, self.end, self.doc, self.place = start[judged], end[judged], doc[judged], place[judged]

    def sizes(self) -> np.ndarray:
        """Shingles of each line, repeats included: its set is as large at most."""
        return np.maximum(self.end - self.start - SHINGLE + 1, 1)

    def marks(self, own: list[int]) -> np.ndarray:
        """One row of MARK_BITS / 8 bytes a line of own: the bits that its shingles' hashes name (see space.possible())."""
        bit = (shingles(self.codes) >> np.uint32(33 - MARK_BITS.bit_length())).astype(np.intp)
        bits = np.zeros((len(own), MARK_BITS), dtype=bool)
        for row, a, n in zip(bits, self.start[own].tolist(), self.sizes()[own].tolist(), strict=True):
            row[bit[a : a + n]] = True
        return np.packbits(bits, axis=1)

    def ids(self) -> np.ndarray:
        """ID_BITS of a hash of each line, the same for copies."""
        h = sums(self.codes.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        return mix(h) >> np.uint64(64 - ID_BITS)

    def keys(self, judged: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(line, band key) of all lines, or of those that judged marks, a line's keys side by side."""
        count = self.sizes()
        h = shingles(self.codes) if len(count) else np.zeros(0, np.uint32)
        owner, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for number, (least, most, rows, bands, passes) in enumerate(KINDS):
            own = np.flatnonzero((count >= least) & (count <= most) & (True if judged is None else judged))
            if len(own):
                found = self._bands(h, own, count[own], rows, bands, passes) ^ np.uint64(0x5851F42D4C957F2D * number & (1 << 64) - 1)
                owner.append(np.repeat(own, bands))
                keys.append(found.ravel())
        line, key = np.concatenate(owner), np.concatenate(keys)
        by = np.argsort(line, kind="stable")
        return line[by], key[by]

    def _bands(self, shingle: np.ndarray, own: np.ndarray, count: np.ndarray, rows: int, bands: int, passes: int) -> np.ndarray:
        """Band keys, one row a line of own."""
        before = np.cumsum(count) - count
        h = shingle[np.repeat((self.start[own] - before).astype(np.int32), count) + np.arange(count.sum(), dtype=np.int32)]
        short = np.flatnonzero(self.end[own] - self.start[own] < SHINGLE)
        if len(short):
            h[before[short]] = short_hashes(self.codes, self.start[own[short]], self.end[own[short]])
        cells = rows * bands // passes
        first = np.repeat(np.arange(len(count), dtype=np.int64) * cells, count)
        out = np.zeros((len(count), bands), dtype=np.uint64)
        mine, part, cell = h.copy(), np.empty_like(h), np.empty(len(h), dtype=np.int64)  # written anew a pass: memory that is fresh each time costs more than the sums
        for p in range(passes):
            if p:  # the first pass takes the shingles' hashes as they are
                np.bitwise_xor(h, np.uint32(0x9E3779B9 * p & 0xFFFFFFFF), out=mine)
                for factor in (0x2C1B3C6D, 0x297A2D39):
                    mine *= np.uint32(factor)
                    np.right_shift(mine, np.uint32(15), out=part)
                    mine ^= part
            np.right_shift(mine, np.uint32(16), out=part)
            part *= np.uint32(cells)
            part >>= np.uint32(16)
            np.add(first, part, out=cell)
            sig = np.full(len(count) * cells, EMPTY, dtype=np.uint32)
            np.minimum.at(sig, cell, mine)
            self._fill(sig, cells)
            for row in sig.reshape(len(count), rows // passes, bands).swapaxes(0, 1):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out += row
        return mix(mix(out) + np.arange(bands, dtype=np.uint64))

    @staticmethod
    def _fill(sig: np.ndarray, cells: int) -> None:
        """Empty cells get the minimum of the first cell from there on, around the end of the line's, that is not empty, and the steps to it."""
        empty = np.flatnonzero(sig == EMPTY)
        end, at, value, own = empty - empty % cells + cells, empty.copy(), np.full(len(empty), EMPTY), np.arange(len(empty))
        for step in range(1, cells):
            if not len(at):
                break
            at += 1
            at[at == end] -= cells
            found = sig[at]
            full = found != EMPTY
            value[own[full]] = found[full] + np.uint32(step)
            at, end, own = at[~full], end[~full], own[~full]
        sig[empty] = value

    def text(self, i: int) -> bytes:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le").encode()


def fingerprint(payload: bytes) -> int:
    """64 bits of a line, besides the ID_BITS of its id."""
    return int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)


def meetings(rows: DataFrame) -> DataFrame:
    """(f1, rid), as a checkpoint: for each line id f1 with a key that another line has, the least id of such a line; with rid null, ids of lines that occur twice.

    Texts are read once for all keys. A key goes to a bucket of its first bits, as 48 others and the line's id, 12 bytes; buckets
    are joined by sorting. There is one for PER_BUCKET texts, to 32,768, and a task holds one at a time.
    """
    spark = small_batches(rows.sparkSession)
    texts = rows.count()
    bits = min(15, max(6, (texts // PER_BUCKET).bit_length()))
    buckets = 1 << bits

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, own = (np.concatenate(x) for x in zip(*held, strict=True))
            every, n = np.unique(np.concatenate(names), return_counts=True)
            every = np.repeat(every, np.minimum(n, 2))
            for bucket, high, low in ((key >> np.uint64(64 - bits), key & MASK, own), ((every >> np.uint64(ID_BITS - bits)) + np.uint64(buckets), every, every)):
                bucket = bucket.astype(np.uint16)
                by = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else by
                entries = np.empty((len(by), 3), dtype=np.uint32)
                high, low = high[by], low[by]
                entries[:, 0], entries[:, 1], entries[:, 2] = high, high >> np.uint64(32) << np.uint64(16) | low >> np.uint64(32), low
                data = sketch.binaries(entries, np.append(edge, len(by)) * entries.itemsize * 3)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[by][edge].astype(np.int32)), data], names=["bucket", "entries"])
            held.clear()
            names.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = Lines(part.column(1))
                ids = lines.ids()
                if len(seen) >= 1_000_000:
                    seen.clear()
                fresh = np.zeros(len(ids), dtype=bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                line, key = lines.keys(fresh)
                held.append((key, ids[line]))
                names.append(ids)
                if sum(len(key) for key, _ in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()  # no trim(): the next task needs the memory again, and fresh pages cost as much as the sums; meet() gives it back

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("bucket",)):
            entries = np.frombuffer(b"".join(rows["entries"].to_pylist()), dtype=np.uint32).reshape(-1, 3).astype(np.uint64)
            key = entries[:, 0] | entries[:, 1] >> np.uint64(16) << np.uint64(32)
            own = entries[:, 2] | (entries[:, 1] & np.uint64(0xFFFF)) << np.uint64(32)
            if rows["bucket"][0].as_py() >= buckets:
                own.sort()
                f1 = np.unique(own[1:][own[1:] == own[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.nulls(len(f1), pa.int64())], names=["f1", "rid"])
                continue
            by = np.argsort(key)
            key, own = key[by], own[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            least, n = np.minimum.reduceat(own, first), np.diff(first, append=len(key))
            some = np.repeat(least != np.maximum.reduceat(own, first), n)  # else of one line only
            f1, rid = own[some], np.repeat(least, n)[some]
            by = np.lexsort((rid, f1))
            f1, rid = f1[by].view(np.int64), rid[by].view(np.int64)
            one = np.append(True, (f1[1:] != f1[:-1]) | (rid[1:] != rid[:-1]))[: len(f1)]
            yield pa.RecordBatch.from_arrays([pa.array(f1[one]), pa.array(rid[one])], names=["f1", "rid"])
        trim()

    parts = min(partitions(spark, texts, 4000), 2 * buckets)
    dealt = rows.mapInArrow(keyed, "bucket int, entries binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(meet, "f1 bigint, rid bigint"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, lines): places, from 0, of the lines that go, as a checkpoint. rows: doc_id bigint, text."""
    spark = rows.sparkSession
    pairs = meetings(rows)
    release(spark)
    homes = cut(pairs.where("rid is not null").groupBy("f1").agg(F.collect_set("rid").alias("rids")))
    near, copied = sketch.Membership(homes.select("f1")), sketch.Membership(pairs.where("rid is null").select("f1"))
    release(spark)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to, copy_of = near.planes(), copied.planes()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = Lines(part.column(1))
                ids = lines.ids()
                h = mix(ids)
                close = near_to.level(h) > 0
                able = np.flatnonzero(close | (copy_of.level(h) > 0))
                if not len(able):
                    continue
                f1, f2, payload = ids[able].view(np.int64), [], []
                for i, x, moved in zip(able.tolist(), f1.tolist(), close[able].tolist(), strict=True):
                    text = lines.text(i)
                    y = fingerprint(text)
                    f2.append(y)
                    if not moved or (x, y) in seen:  # without a partner; or a copy in this task: the first one stands for it
                        payload.append(None)
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add((x, y))
                    payload.append(text)
                first = np.array([x is not None for x in payload])
                mark = iter(lines.marks(able[first].tolist()))
                marks = [None if x is None else next(mark).tobytes() for x in payload]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f2, pa.int64()), pa.array(f1), pa.array(f2, pa.int64()), pa.array(marks, pa.binary()), pa.array(lines.sizes()[able].astype(np.int32)), pa.array(payload, pa.binary()),
                        pa.array(part.column(0).to_numpy(zero_copy_only=False)[lines.doc[able]], pa.int64()), pa.array(lines.place[able].astype(np.int32)),
                    ],
                    names=["id", "f1", "f2", "mark", "size", "payload", "doc_id", "line"],
                )
        trim()

    with stored(rows.mapInArrow(points, SCHEMA), "lines") as found:
        near.close()  # the table is written; the filters need no memory any more, here or there
        copied.close()
        release(spark)
        classes = class_of_points(found, line_set, PERCENT, homes=homes)
        first = found.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "line")).alias("first"))
        winners = cut(first.join(classes, ["f1", "f2"]))
        best = cut(winners.groupBy("component").agg(F.min("first").alias("stays"), F.count("*").alias("__n")))
        release(spark)
        verdicts = cut(spread_join(winners, best.select("component", "stays"), ["component"], counts=best).select("f1", "f2", "stays"))
        gone = spread_join(found.select("f1", "f2", "doc_id", "line"), verdicts, ["f1", "f2"]).where(F.struct("doc_id", "line") != F.col("stays"))
        return cut(gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines cut out of its texts, and two more columns, n_lines and n_removed (in place of any that docs has by these names).

    Lines end at LF. Lines without a word are never judged; every other line is, however short. Null texts stay
    null. Only documents that lose lines are shuffled. Rows that repeat a doc_id are edited alike; rows with a null id are left as they are. A
    document may lose all its lines; it stays, with an empty text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    gone, key = "__veritide_gone", "__veritide_id"
    cuts = repeated_lines(rows).select(F.col("doc_id").alias(key), F.col("lines").alias(gone))
    release(docs.sparkSession)
    touched = sketch.Membership(cuts.select(key))
    own = F.col(id_col).cast("bigint")
    rest = docs.where(~touched(own)).withColumn(gone, F.lit(None).cast("array<int>"))
    joined = rest.unionByName(docs.where(touched(own)).join(cuts.hint("shuffle_hash"), own == F.col(key), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone))
    lines = F.split(F.col(text_col), "\n")
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = joined.select(*others, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left).alias(text_col), n_lines.alias("__veritide_n"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("__veritide_r"))
    stay = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*stay, F.col("__veritide_n").alias("n_lines"), F.col("__veritide_r").alias("n_removed"))


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for every row; null texts have no line and the digest of the empty text. Otherwise as line_dedup()."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    edited = line_dedup(narrow)
    return edited.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
