"""Substring deduplication of word windows behind a count-min prefilter.

A window is WINDOW consecutive words of one document. A word goes when a window over it also starts
in a document of a smaller id. First pass: partition sketches of all windows are merged; a window
whose estimate stays below two occurs once and cannot repeat. Second pass: only windows estimated
twice or more are grouped exactly, by 96 bits of hash. Within one task a window's later
documents are decided at once, so only its first document there is shuffled, and a passage that a
third of all documents share costs one row per task. Only documents that lose words, and the few that a
Bloom filter of their ids takes for such, are shuffled to be edited; the others are read in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm import sketch
from veritide.llm.cluster import cut, release
from veritide.llm.words import Words, slices, trim

WINDOW, DEPTH, PER_WINDOW, FLUSH = 13, 2, 3.5, 1_000_000
_CHECK = np.uint64(0xFFFFFFFF00000000)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch, "text"):
        yield Words(part.column(1)).windows(WINDOW)[1]


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last + 1) of runs of consecutive window starts; input sorted by doc and place."""
    if not len(doc):
        return doc, at, at
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], at[last] + 1


def repeated_windows(rows: DataFrame, planes: list[bytes], log2: int) -> DataFrame:
    """(doc_id, run): runs of window starts of windows that also start in a smaller doc_id, as first << 32 | last, last exclusive. rows: doc_id bigint, text."""
    shared = rows.sparkSession.sparkContext.broadcast(planes)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = sketch.Planes(shared.value, log2, DEPTH)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, c, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc, c, h))
            h, c, doc, at = h[order], c[order], doc[order], at[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = doc > least
            d, p = doc[later], at[later]
            by = np.lexsort((p, d))
            d, first, last = _runs(d[by], p[by])
            ours = ~later
            key = np.concatenate([h[ours].view(np.int64), d * np.int64(0x5851F42D4C957F2D)])
            packed = np.concatenate([(c[ours] | at[ours].astype(np.uint64)).view(np.int64), first << 32 | last])
            docs, kind = np.concatenate([doc[ours], d]), np.concatenate([np.ones(ours.sum(), bool), np.zeros(len(d), bool)])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(packed), pa.array(docs), pa.array(kind)], names=["key", "packed", "doc_id", "open"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                start, h = words.windows(WINDOW)
                hit = plane.level(h) > 0
                if hit.any():
                    start, h = start[hit], h[hit]
                    _, c = words.windows(WINDOW, 1)
                    row = words.row[start]
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    held.append((h, c[hit] & _CHECK, ids[row], start - words.first[row]))
                    size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held = []
        trim()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by key, check bits and document: a window's rows are neighbours, its least document first."""
        before = (None, None, None)
        for batch in batches:
            key, packed, doc, check = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            opened = batch.column(3).to_numpy(zero_copy_only=False)
            done = ~opened
            key, check, wdoc, at = key[opened], check[opened], doc[opened], (packed[opened] & 0xFFFFFFFF)
            out_doc, out_run = doc[done], packed[done]
            if len(key):
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
                new[0] = (key[0], check[0]) != before[:2]
                group = np.cumsum(new)
                leaders = wdoc[np.flatnonzero(new)]
                least = np.concatenate([[before[2] if before[2] is not None else 0], leaders])[group]
                later = wdoc > least
                before = (key[-1], check[-1], least[-1])
                out_doc = np.concatenate([out_doc, wdoc[later]])
                out_run = np.concatenate([out_run, at[later] << 32 | at[later] + 1])
            if len(out_doc):
                yield pa.RecordBatch.from_arrays([pa.array(out_doc), pa.array(out_run)], names=["doc_id", "run"])

    found = rows.mapInArrow(survivors, "key bigint, packed bigint, doc_id bigint, open boolean")
    check = F.when(F.col("open"), F.shiftright("packed", 32)).otherwise(F.lit(0))
    parts = found.repartition("key").withColumn("check", check.cast("int")).sortWithinPartitions("key", "check", "doc_id")
    return parts.mapInArrow(settle, "doc_id bigint, run bigint")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_log2: int = sketch.MOST_LOG2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; kept is the remaining words joined by one space.

    Null or empty text has no words. Rows that repeat a doc_id are one document: the same
    places go from each of them. Rows with a null id are never judged and keep all words.
    """
    return _edited(docs, id_col, text_col, most_log2, False)


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """substring_dedup() with kept_sha256 in place of the words, taken where they are cut."""
    return _edited(docs, id_col, text_col, sketch.MOST_LOG2, True)


def _edited(docs: DataFrame, id_col: str, text_col: str, most_log2: int, digest: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    log2 = sketch.log2_cells(sketch.text_size(known) // 6, PER_WINDOW, most_log2)
    planes = sketch.build(known, _hashes, log2, DEPTH, (2,))
    gone = cut(repeated_windows(known, planes, log2).groupBy("doc_id").agg(F.collect_list("run").alias("gone")))
    release(rows.sparkSession)
    touched = sketch.Membership(gone.select("doc_id"))
    name = "kept_sha256" if digest else "kept"

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total = len(words)
                if spans.is_valid and total:
                    runs = spans.values.to_numpy()
                    mark = np.zeros(total + 1, dtype=np.int32)
                    np.add.at(mark, np.minimum(runs >> 32, total), 1)
                    np.add.at(mark, np.minimum((runs & 0xFFFFFFFF) + WINDOW - 1, total), -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                joined = b" ".join(words)
                n_words.append(total)
                n_removed.append(total - len(words))
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = pa.array(~touched.test(batch.column(0).to_pandas(integer_object_nulls=True)).to_numpy())
            rest = batch.filter(stay)
            yield from edit(iter([rest.append_column("gone", pa.nulls(len(rest), pa.list_(pa.int64())))]))

    schema = f"doc_id bigint, n_words bigint, n_removed bigint, {name} string"
    joined = rows.where(touched("doc_id")).join(gone.hint("shuffle_hash"), "doc_id", "left")
    return rows.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(edit, schema))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h JOIN m USING (k) WHERE doc_id > least),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
e AS (SELECT d.doc_id, unnest(d.w) AS word, generate_subscripts(d.w, 1) AS j FROM d),
k AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) FILTER (c.j IS NULL) AS kept
  FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.j = e.j GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
