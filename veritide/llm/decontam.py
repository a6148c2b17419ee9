"""Benchmark decontamination by greedy string tiling.

Seeds of LEAST words shared by a text and a benchmark item select pairs. On each pair, running
Karp-Rabin matching finds the longest common passages that are not marked yet, marks them without
overlap, and goes on with shorter ones down to LEAST words. The share of the item that tiles cover
decides, wherever in the text, and in whatever order, the tiles stand.

Items go to the executors in blocks of BLOCK_BYTES of text at most; each block is compared with all
texts, so a larger benchmark means more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.words import Words, slices

LEAST, PERCENT, BLOCK_BYTES = 4, 60, 4_000_000
_BASE, _MOD = 1_000_003, (1 << 61) - 1
SCHEMA = "doc_id bigint, item_id bigint, item_words bigint, covered bigint, tiles string"


def rolling(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of that many free tokens."""
    top, h, run = pow(_BASE, length - 1, _MOD), 0, 0
    for i, t in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        if run == length:
            h = (h - tokens[i - length] * top) % _MOD
            run -= 1
        h = (h * _BASE + t) % _MOD
        run += 1
        if run == length:
            yield i - length + 1, h


def tile(text: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in text, place in item, length) of greedy tiles of at least so many tokens; no token lies in two."""
    free_text, free_item = [True] * len(text), [True] * len(item)
    out: list[tuple[int, int, int]] = []
    search = max(least, min(len(text), len(item)))
    while True:
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        table: dict[int, list[int]] = defaultdict(list)
        for j, h in rolling(item, free_item, search):
            table[h].append(j)
        longest = 0
        for i, h in rolling(text, free_text, search) if table else ():
            for j in table.get(h, ()):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and free_text[i + k] and free_item[j + k]:
                    k += 1
                if k >= search:
                    found[k].append((i, j))
                    longest = max(longest, k)
        if longest > 2 * search:
            search = longest
            continue
        before = len(out)
        for k in sorted(found, reverse=True):
            for i, j in found[k]:
                if all(free_text[i : i + k]) and all(free_item[j : j + k]):
                    free_text[i : i + k] = free_item[j : j + k] = [False] * k
                    out.append((i, j, k))
        if search > 2 * least:
            search //= 2
        elif search > least:
            search = least
        elif len(out) == before:  # until then, what is left of matches that overlap a tile is searched again
            return sorted(out)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[pa.Table]:
    """The items in blocks of a bounded size."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for b in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).toArrow()


def item_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles) for pairs where tiles cover percent of the item's words or more.

    Words are compared after lower-casing A-Z. tiles is place:place-in-item:length, comma-joined.
    Null texts match nothing, items of fewer than LEAST words are no evidence, rows with null ids are
    left out, repeated rows count again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(items, item_id, item_text):
        words = Words(block["text"].combine_chunks(), lower=True)
        start, seed = words.windows(LEAST)
        order = np.argsort(seed, kind="stable")
        shared = spark.sparkContext.broadcast(
            (seed[order], words.row[start][order], (start - words.first[words.row[start]])[order], words.first, words.hashes(), np.asarray(block["item_id"].to_pylist(), dtype=np.int64))
        )
        out = out.unionByName(rows.mapInArrow(_matcher(shared, percent), SCHEMA))
    return out


def _matcher(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, seed_item, seed_place, first, item_hash, item_ids = shared.value
        for batch in batches:
            made: list[tuple[int, int, int, int, str]] = []
            for part in slices(batch, "text"):
                words = Words(part.column(1), lower=True)
                start, h = words.windows(LEAST)
                at = np.searchsorted(seeds, h)
                hit = at < len(seeds)
                hit[hit] = seeds[at[hit]] == h[hit]
                if not hit.any():
                    continue
                start, h = start[hit], h[hit]
                row, lo, hi = words.row[start], np.searchsorted(seeds, h), np.searchsorted(seeds, h, side="right")
                pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for s, r, a, b in zip(start.tolist(), row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for x in range(a, b):
                        pairs[r, int(seed_item[x])].append((s, int(seed_place[x])))
                ids = part.column(0)
                for (r, i), hits in pairs.items():
                    size = int(first[i + 1] - first[i])
                    if 100 * len({p + k for _, p in hits for k in range(LEAST)}) < percent * size:
                        continue  # tiles lie within seeds
                    places = sorted({s + k for s, _ in hits for k in range(LEAST)})
                    text, where = [], []
                    for k, p in enumerate(places):
                        if k and p != places[k - 1] + 1:
                            text.append(-1)
                            where.append(-1)
                        text.append(int(words.hashes()[p]))
                        where.append(p - int(words.first[r]))
                    tiles = tile(text, item_hash[first[i] : first[i + 1]].tolist())
                    covered = sum(k for _, _, k in tiles)
                    if 100 * covered >= percent * size:
                        made.append((ids[r].as_py(), int(item_ids[i]), size, covered, ",".join(f"{where[a]}:{b}:{k}" for a, b, k in tiles)))
            if made:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "item_words", "covered", "tiles"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that match an item, all columns kept."""
    flagged, key = item_matches(docs, items, id_col, text_col), "__veritide_id"
    flagged = flagged.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(flagged, F.col(id_col).cast("bigint") == F.col(key), "left_anti")
