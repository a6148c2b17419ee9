"""Exact similarity search, reranking order, near-duplicate removal and source-diverse selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that a worker holds at a time, in a few arrays of so many numbers.
SCORES = 500_000
QUERY_BLOCK_BYTES = 64_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def document_filter(value: str | dict | None, columns: tuple[str, str, str] = ("document_id", "filename", "title")) -> Column:
    """A string matches id, file name or title exactly; a dict's given fields must all match; None and the empty dict let all pass."""
    if value is None:
        return F.lit(True)
    if isinstance(value, dict):
        out = F.lit(True)
        for name, want in value.items():
            out = out & (F.col(name) == want)
        return out
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name) == value, F.lit(False))
    return out


def top_one(chunks: DataFrame, query: list[float], limit: int, id_col: str = "citation_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The best chunks for one query vector, filtered before the cut; ties by id. One TakeOrdered, no shuffle of vectors."""
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = chunks if where is None else chunks.where(where)
    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 9)
    return rows.withColumn("vector_score", score).where("vector_score is not null").orderBy(F.desc("vector_score"), id_col).limit(limit)


def top_many(chunks: DataFrame, queries: DataFrame, limit: int, id_col: str = "citation_id", vector: str = "embedding", block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(query_id, id, vector_score, vector_rank): the best chunks for each of queries (query_id, embedding).

    Query vectors go to the executors in blocks of a bounded size. Each task multiplies its batches with a
    block and keeps only the best so far of every query, so what is shuffled is limit rows a query and task.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    types = dict(chunks.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {types['query_id']}, {id_col} {types[id_col]}, vector_score double"
    size = queries.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size * 8 // block_bytes))
    rows, out = chunks.select(id_col, vector), None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        table = part.select("query_id", "embedding").where("embedding is not null").toArrow()
        best = rows.mapInArrow(_scorer(table, limit, schema, id_col), schema)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), id_col)
    return out.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= limit)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of length one; zero vectors become NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return flat / norm


def _best_of(found: pa.Table, limit: int, id_col: str) -> pa.Table:
    """Of rows (query, id, vector_score) the best of every query, ties by id."""
    found = found.take(pa.compute.sort_indices(found, [("query", "ascending"), ("vector_score", "descending"), (id_col, "ascending")]))
    query = found["query"].to_numpy()
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return found.filter(pa.array(rank < limit))


def best_in(q: np.ndarray, batches: Iterable[pa.RecordBatch], limit: int, id_col: str) -> pa.Table:
    """(query, id, vector_score): the best of batches (id, vector) for each row of q, which have length one; query counts rows of q."""
    held: list[pa.Table] = []
    kind = None
    step = max(limit, SCORES // max(1, len(q)))  # a bounded number of scores at a time
    for batch in (whole.slice(at, step) for whole in batches for at in range(0, len(whole), step)):
        kind = batch.column(0).type
        batch = batch.filter(pa.compute.is_valid(batch.column(1)))
        if not len(batch) or not len(q):
            continue
        batch = batch.take(pa.compute.sort_indices(batch.column(0)))  # of equal scores the least ids come first
        scores = q @ unit_rows(batch.column(1)).T
        np.round(scores, 9, out=scores)
        # one integer a score, unlike all others of its row, least first: the score in units of 1e-9, then the place in the batch
        units = scores * -1e9
        np.rint(units, out=units)
        units[np.isnan(scores)] = float(1 << 31)  # behind all scores, which are 1e9 at most
        key = units.astype(np.int64)
        del units
        key *= step
        key += np.arange(len(batch))
        top = np.argpartition(key, limit - 1, axis=1)[:, :limit].copy() if len(batch) > limit else np.broadcast_to(np.arange(len(batch)), scores.shape)
        who, place = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
        score = scores[who, place]
        sound = ~np.isnan(score)
        held.append(pa.table({"query": who[sound], id_col: batch.column(0).take(pa.array(place[sound])), "vector_score": score[sound]}))
        if sum(map(len, held)) > 4 * limit * len(q):
            held = [_best_of(pa.concat_tables(held), limit, id_col)]
    if held:
        return _best_of(pa.concat_tables(held), limit, id_col)
    return pa.table({"query": np.zeros(0, np.int64), id_col: pa.array([], kind or pa.null()), "vector_score": np.zeros(0)})


def _scorer(queries: pa.Table, limit: int, schema: str, id_col: str):
    ids, vectors = queries["query_id"].combine_chunks(), queries["embedding"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        best = best_in(unit_rows(vectors), batches, limit, id_col)
        if len(best):
            out = pa.table({"query_id": ids.take(best["query"].combine_chunks()), id_col: best[id_col], "vector_score": best["vector_score"]})
            yield from out.combine_chunks().to_batches()

    return run


def rerank(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, relevance_score, vector_rank, ...) with rank: by relevance, ties in vector order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "vector_rank")
    return candidates.withColumn("rank", F.row_number().over(order))


def near_duplicates_out(ranked: DataFrame, threshold: float = 0.9) -> DataFrame:
    """ranked (query_id, rank, document_id, fingerprint, text, ...) without rows that repeat a kept one of the same document.

    Whether a row goes depends on the rows kept before it, so each query's shortlist (a bounded number of rows) is
    walked in Python. Similarity is the ratio of the standard library's sequence matcher.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        kept: dict = {}
        stays = []
        for doc, mark, text in zip(rows["document_id"], rows["fingerprint"], rows["text"], strict=True):
            text = text or ""
            same = any(mark == m or close(text, x, threshold) for m, x in kept.get(doc, ()))
            stays.append(not same)
            if not same:
                kept.setdefault(doc, []).append((mark, text))
        return rows[stays]

    return ranked.groupBy("query_id").applyInPandas(keep, ranked.schema)


def close(new: str, old: str, threshold: float) -> bool:
    """Is the ratio of new against old at least threshold? Cheap upper bounds come first."""
    m = SequenceMatcher(None, new, old)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def select_results(ranked: DataFrame, top_k: int, diverse: bool = True) -> DataFrame:
    """The first top_k of every query, with position; if diverse, the best of every document come before the rest."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    of_document = Window.partitionBy("query_id", "document_id").orderBy("rank")
    later = (F.row_number().over(of_document) > 1) if diverse else F.lit(False)
    rows = ranked.withColumn("__later", later)
    order = Window.partitionBy("query_id").orderBy("__later", "rank")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k).drop("__later")


def result_json(score: Column) -> Column:
    """The compact JSON object of a result row."""
    source = F.coalesce(F.nullif("title", F.lit("")), F.col("filename"))
    return F.to_json(F.struct("citation_id", source.alias("source"), "page", "section", score.alias("score"), "text"), {"ignoreNullFields": "false"})


def result_line(score: Column) -> Column:
    """The readable form of a result row."""
    source = F.coalesce(F.nullif("title", F.lit("")), F.col("filename"))
    return F.format_string("[%s] %s (page %s, score %.3f)\n%s", "citation_id", source, F.col("page").cast("string"), score, "text")
