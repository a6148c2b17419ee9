"""Batch search: embed, exact top candidates, rerank, near-duplicate removal, diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.config import EngineConfig
from veritide.functions.patterns import NO_SPACE
from veritide.functions.scoring import Embedder, PairScorer, embedding_of, pair_score
from veritide.operators import retrieval
from veritide.operators.blocks import VectorBlocks, nearest


SHORTLIST_ROWS = 500_000


def search_chunks(chunks: DataFrame, asked: DataFrame, embedder: Embedder, reranker: PairScorer, config: EngineConfig = EngineConfig(), top_k: int | None = None, where: Column | None = None, index: VectorBlocks | None = None) -> DataFrame:
    """Results (query_id, position, chunk columns, vector_score, relevance_score) for asked (query_id, query).

    A null or blank query and a top_k below 1 are refused. Vectors of the store are read once for all queries; only the
    shortlists of each query reach the reranker. With an index of the same chunks, which has to keep the columns that where
    names, only the blocks that queries meet are read.
    """
    top_k = config.result_count if top_k is None else top_k
    if top_k < 1:
        raise ValueError("top_k must be positive")
    n, blank = asked.agg(F.count("*"), F.count_if(F.col("query").isNull() | ~F.col("query").rlike(NO_SPACE))).first()
    if blank:
        raise ValueError(f"query must not be empty ({blank} of {n} are)")
    stored = chunks if where is None else chunks.where(where)
    vectors = asked.select("query_id", embedding_of(F.col("query"), embedder).alias("embedding"))
    limit = max(top_k, config.vector_candidates)
    best = retrieval.top_many(stored, vectors, limit) if index is None else nearest(index, vectors, limit, where)
    # a shortlist has limit rows a query, so its size is known; while small it goes to the texts, not the texts to it
    small = n * limit <= SHORTLIST_ROWS
    short = stored.drop("embedding").join(F.broadcast(best) if small else best, "citation_id").join(asked, "query_id")
    scored = short.withColumn("relevance_score", pair_score(F.col("query"), F.col("text"), reranker))
    unique = retrieval.near_duplicates_out(retrieval.rerank(scored), config.deduplication_threshold)
    return retrieval.select_results(unique, top_k, config.source_diversity)


def alternatives(claims: DataFrame, chunks: DataFrame, embedder: Embedder, reranker: PairScorer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(draft_id, claim_pos, alternatives): up to three other passages for each of claims (draft_id, claim_pos, plain)."""
    keyed = claims.select("draft_id", "claim_pos", F.concat_ws("\u0001", "draft_id", "claim_pos").alias("query_id"), F.col("plain").alias("query"))
    found = search_chunks(chunks, keyed.select("query_id", "query"), embedder, reranker, config, top_k=3)
    ids = found.groupBy("query_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("position", "citation_id"))), lambda x: x["citation_id"])).alias("alternatives"))
    return keyed.select("draft_id", "claim_pos", "query_id").join(ids, "query_id").drop("query_id")
