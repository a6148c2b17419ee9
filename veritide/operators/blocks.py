"""Exact similarity search over blocks of vectors, of which a query meets only those that can hold one of its best.

Every vector lies in the block of its nearest pivot, with its angle to it. Angles obey the triangle inequality: with a
query at angle t from the pivot, a vector at angle a from it is at least |t - a| and at most t + a from the query. Two
upper bounds of a query's limit-th smallest angle are known before any block is read: the limit-th smallest
among the anchors (a bounded sample of the rows themselves), and the reach of the nearest rings that hold limit rows
together. A block all of whose rings lie beyond the smaller one is skipped; nothing else is, so results equal those of a
search through all rows. Blocks and the queries that meet them come together in one shuffle, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from veritide.operators.retrieval import best_in, unit_rows

#: Pivots are fitted on, and bounds come from, SAMPLE rows at most: those whose ids have the least hashes.
PIVOTS, SAMPLE, ROUNDS = 256, 4096, 6
#: Rings of a block per radian of angle.
RINGS = 16
STORE_ROWS, QUERY_ROWS = 16_384, 4_096
#: Scores are rounded to nine decimals, which near zero is an angle of 4.5e-5; ties must not be lost to that.
SLACK = 1e-4
BLOCK, ANGLE = "veritide_block", "veritide_angle"


def fit_pivots(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Spherical k-means over rows of length one, from the first of them; a centre that loses its rows stays where it was."""
    centres = vectors[:pivots].copy()
    for _ in range(ROUNDS if len(centres) else 0):
        sums = np.zeros_like(centres)
        np.add.at(sums, np.argmax(vectors @ centres.T, axis=1), vectors)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _placed(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(ANGLE, DoubleType()), StructField(BLOCK, IntegerType())])


def _angles(scores: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(scores, -1.0, 1.0))


def _sound(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors that have a direction, as rows of length one."""
    given = column.combine_chunks().drop_null()
    if not len(given):
        return np.zeros((0, 1))
    rows = unit_rows(given)
    return rows[~np.isnan(rows).any(axis=1)]


@dataclass(frozen=True)
class VectorBlocks:
    """An index in a folder of its own: blocks/ (partitioned by block), pivots/ and anchors/, all plain Parquet."""

    spark: SparkSession
    path: str
    id_col: str = "citation_id"
    vector: str = "embedding"

    def anchors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/anchors")

    def pivots(self) -> np.ndarray:
        """One row of length one a block; PIVOTS of them at most."""
        found = self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").toArrow()
        return unit_rows(found["direction"].combine_chunks()) if len(found) else np.zeros((0, 1))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_placed(self.anchors().schema)).parquet(f"{self.path}/blocks")


def write_blocks(chunks: DataFrame, path: str, id_col: str = "citation_id", vector: str = "embedding", keep: tuple[str, ...] = (), pivots: int = PIVOTS, sample: int = SAMPLE) -> VectorBlocks:
    """Indexes all rows of chunks that have a vector with a direction; keep names further columns, for filters.

    Ids are unique. Null and zero vectors have no score and are left out; an empty table gives an empty index. path must be new.
    """
    if pivots < 1 or sample < pivots:
        raise ValueError("pivots must be positive and no more than the sample")
    spark, index = chunks.sparkSession, VectorBlocks(chunks.sparkSession, path, id_col, vector)
    rows = chunks.select(id_col, vector, *keep).where(F.col(vector).isNotNull())
    rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).write.parquet(f"{path}/anchors")
    centres = fit_pivots(_sound(index.anchors().select(vector).toArrow()[vector]), pivots)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "pivot int, direction array<double>").coalesce(1).write.parquet(f"{path}/pivots")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not len(centres):
                continue
            scores = unit_rows(batch.column(vector)) @ centres.T
            sound = ~np.isnan(scores).any(axis=1)
            scores, batch = scores[sound], batch.filter(pa.array(sound))
            block = np.argmax(scores, axis=1)
            angle = _angles(scores[np.arange(len(block)), block])
            yield batch.append_column(ANGLE, pa.array(angle)).append_column(BLOCK, pa.array(block.astype(np.int32)))

    # a large block is split among tasks, small ones share a task
    rows.mapInArrow(assign, _placed(rows.schema)).hint("rebalance", BLOCK).write.partitionBy(BLOCK).parquet(f"{path}/blocks")
    return index


def rings(rows: DataFrame) -> DataFrame:
    """(block, lo, hi, n): how far from the pivot the rows of every ring lie. 51 rings a block at most; no vector is read."""
    return rows.groupBy(F.col(BLOCK).alias("block"), F.floor(F.col(ANGLE) * RINGS).alias("ring")).agg(F.min(ANGLE).alias("lo"), F.max(ANGLE).alias("hi"), F.count("*").alias("n")).drop("ring")


def meetings(index: VectorBlocks, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """(query_id, embedding, block): the blocks that each of queries (query_id, embedding) has to meet; where filters the stored rows first."""
    if limit < 1:
        raise ValueError("limit must be positive")
    of = lambda rows: rows if where is None else rows.where(where)
    cells = rings(of(index.rows())).orderBy("block", "lo").toArrow()
    block, lo, hi, n = (cells[c].to_numpy() for c in ("block", "lo", "hi", "n"))
    anchors = _sound(of(index.anchors()).select(index.vector).toArrow()[index.vector])
    centres = index.pivots()
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                q = unit_rows(batch.column(1))
                sound = ~np.isnan(q).any(axis=1)
                q, batch = q[sound], batch.filter(pa.array(sound))
                if not len(batch) or not len(block):
                    continue
                away = _angles(q @ centres.T)[:, block]  # of each query from the pivot of each ring
                reach = away + hi
                order = np.argsort(reach, axis=1)
                held = np.cumsum(n[order], axis=1)
                bound = np.where(held[:, -1] >= limit, np.take_along_axis(reach, np.take_along_axis(order, np.argmax(held >= limit, axis=1)[:, None], 1), 1)[:, 0], np.inf)
                if len(anchors) >= limit:
                    bound = np.minimum(bound, _angles(np.partition(q @ anchors.T, -limit, axis=1)[:, -limit]))
                nearest = np.maximum(np.maximum(away - hi, lo - away), 0.0)
                meets = np.minimum.reduceat(nearest, first, axis=1) <= bound[:, None] + SLACK
                who, cell = np.nonzero(meets)
                ids = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(block[first][cell].astype(np.int32))], names=["query_id", "embedding", "block"])

    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.mapInArrow(meet, StructType([*asked.schema.fields, StructField("block", IntegerType())]))


def nearest(index: VectorBlocks, queries: DataFrame, limit: int, where: Column | None = None, store_rows: int = STORE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, id, vector_score, vector_rank): what retrieval.top_many finds, from the blocks that can hold it.

    Blocks of more than store_rows rows are split by id, queries of one block beyond query_rows by query id, and every
    slice of one meets every slice of the other, so that no task holds more than one of each. Blocks that no
    query meets are not read. Null and zero query vectors find nothing.
    """
    met = meetings(index, queries, limit, where)
    rows = index.rows() if where is None else index.rows().where(where)
    asked = {r["block"]: -(-r["n"] // query_rows) for r in met.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = {r["block"]: -(-r["n"] // store_rows) for r in rings(rows).groupBy("block").agg(F.sum("n").alias("n")).collect() if r["block"] in asked}
    id_col, vector, types = index.id_col, index.vector, dict(rows.dtypes) | {"query_id": dict(met.dtypes)["query_id"]}
    schema = f"query_id {types['query_id']}, {id_col} {types[id_col]}, vector_score double"
    if not asked:
        return index.spark.createDataFrame([], schema + ", vector_rank int")
    slices = lambda of, block: F.element_at(F.create_map(*[F.lit(int(x)) for p in of.items() for x in p]), block)
    # cogroup hashes the keys of both sides as they are: an int and a bigint of the same value would land in different tasks
    part = lambda of, block, key: F.pmod(F.xxhash64(key), slices(of, block)).cast("int")
    every = lambda of, block: F.explode(F.sequence(F.lit(0), slices(of, block) - 1))
    block = F.col(BLOCK)
    left = rows.where(block.isin(*asked)).select(block.alias("block"), part(sizes, block, id_col).alias("part"), every(asked, block).alias("asked"), id_col, vector)
    right = met.select("block", every(sizes, F.col("block")).alias("part"), part(asked, F.col("block"), "query_id").alias("asked"), "query_id", "embedding")
    by = ["block", "part", "asked"]

    def score(stored: pa.Table, queries: pa.Table) -> pa.Table:
        ids = queries["query_id"].combine_chunks()
        q = unit_rows(queries["embedding"].combine_chunks()) if len(ids) else np.zeros((0, 1))
        best = best_in(q, stored.select([id_col, vector]).to_batches(), limit, id_col)
        return pa.table({"query_id": ids.take(best["query"].combine_chunks()), id_col: best[id_col].cast(stored.schema.field(id_col).type), "vector_score": best["vector_score"]})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), id_col)
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= limit)


def pruning(index: VectorBlocks, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """One row: queries that met a block, pairs of query and block in all and met, and the same in rows."""
    own = rings(index.rows() if where is None else index.rows().where(where)).groupBy("block").agg(F.sum("n").alias("n"))
    whole = own.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    met = meetings(index, queries, limit, where).select("query_id", "block").join(F.broadcast(own), "block")
    seen = met.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("met_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("met_rows"))
    return seen.crossJoin(F.broadcast(whole)).select("queries", (F.col("queries") * F.col("blocks")).alias("pairs"), "met_blocks", (F.col("queries") * F.col("rows")).alias("row_pairs"), "met_rows")
