"""The block index of vectors against a search through all rows and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.functions import scoring
from veritide.operators import blocks, chunking, retrieval
from veritide.plans import catalogue
from veritide.plans.search import search_chunks

VECTORS = "citation_id bigint, embedding array<double>, kind string"
QUERIES = "query_id bigint, embedding array<double>"


def clustered(spark, seed=5, hot=600, others=900):
    """A third of the rows in one narrow bundle with many exact copies, the rest in thirty bundles, and rows without a direction."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(31, 16))
    own = np.concatenate([np.zeros(hot, int), 1 + rng.integers(0, 30, others)])
    x = centres[own] + 0.15 * rng.normal(size=(len(own), 16))
    x[: hot // 3] = x[0]
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)]
    rows += [(9000, None, "a"), (9001, [0.0] * 16, "a")]
    asked = [(i, (3 * x[j] + 0.1 * rng.normal(size=16)).tolist()) for i, j in enumerate(range(0, len(x), 25))]
    asked += [(900, x[0].tolist()), (901, rng.normal(size=16).tolist()), (902, None), (903, [0.0] * 16), (904, (-x[3]).tolist())]
    return spark.createDataFrame(rows, VECTORS).repartition(5), spark.createDataFrame(asked, QUERIES).repartition(3)


def found(df):
    return {(r["query_id"], r["vector_rank"]): (r["citation_id"], r["vector_score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    vectors, asked = clustered(spark)
    index = blocks.write_blocks(vectors, str(tmp_path_factory.mktemp("vectors") / "index"), keep=("kind",), pivots=40, sample=400)
    return vectors.cache(), asked.cache(), index


def test_blocks_find_what_a_search_of_all_rows_finds(made):
    vectors, asked, index = made
    for limit in (1, 7, 50):
        assert found(blocks.nearest(index, asked, limit)) == found(retrieval.top_many(vectors, asked, limit))


def test_blocks_against_numpy(made):
    vectors, asked, index = made
    rows = sorted((r["citation_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] and any(r["embedding"]))
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    got = found(blocks.nearest(index, asked, 5))
    for r in asked.collect():
        if not r["embedding"] or not any(r["embedding"]):
            assert (r["query_id"], 1) not in got
            continue
        q = np.array(r["embedding"])
        score = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 9)
        want = sorted(zip(-score, ids, strict=True))[:5]
        assert [got[r["query_id"], k + 1][0] for k in range(5)] == [i for _, i in want]


def test_large_blocks_and_many_queries_are_split(made):
    """Slices far smaller than the hot block and its queries: same rows."""
    vectors, asked, index = made
    assert found(blocks.nearest(index, asked, 9, store_rows=50, query_rows=4)) == found(retrieval.top_many(vectors, asked, 9))
    assert index.rows().groupBy(blocks.BLOCK).count().agg(F.max("count")).first()[0] > 3 * 50


def test_both_sides_meet_in_one_task_of_many(spark, made):
    """More tasks than groups, none merged: a key of another type on one side would send it elsewhere."""
    vectors, asked, index = made
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = found(blocks.nearest(index, asked, 7))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == found(retrieval.top_many(vectors, asked, 7))


def test_filters_come_before_the_cut(made):
    vectors, asked, index = made
    own = F.col("kind") == "b"
    assert found(blocks.nearest(index, asked, 6, where=own)) == found(retrieval.top_many(vectors.where(own), asked, 6))
    few = F.col("citation_id") < 3
    assert found(blocks.nearest(index, asked, 6, where=few)) == found(retrieval.top_many(vectors.where(few), asked, 6))


def test_most_blocks_are_skipped_where_vectors_lie_in_bundles(made):
    _, asked, index = made
    share = blocks.pruning(index, asked, 5).first()
    assert share["queries"] == asked.count() - 2
    assert share["met_blocks"] < 0.3 * share["pairs"] and share["met_rows"] < 0.5 * share["row_pairs"]


def test_blocks_that_no_query_meets_are_not_read(spark, made):
    vectors, _, index = made
    one = spark.createDataFrame([(1, vectors.where("citation_id = 700").first()["embedding"])], QUERIES)
    met = {r["block"] for r in blocks.meetings(index, one, 3).collect()}
    whole = index.rows().select(blocks.BLOCK).distinct().count()
    assert len(met) < whole / 3
    text = blocks.nearest(index, one, 3)._jdf.queryExecution().executedPlan().toString()
    assert blocks.BLOCK in text.split("PartitionFilters: [")[1].split("]")[0]


def test_bounds_read_no_vectors(made):
    text = blocks.rings(made[2].rows())._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{blocks.ANGLE}:double>" in text


def test_empty_tables(spark, made, tmp_path):
    vectors, asked, index = made
    nothing = blocks.write_blocks(vectors.where("false"), str(tmp_path / "none"))
    blank = blocks.write_blocks(vectors.where("citation_id >= 9000"), str(tmp_path / "blank"))
    for empty in (nothing, blank):
        assert blocks.nearest(empty, asked, 3).count() == 0 and empty.rows().count() == 0
    assert blocks.nearest(index, asked.where("false"), 3).count() == 0
    assert blocks.pruning(nothing, asked, 3).first()["pairs"] == 0
    for bad in (lambda: blocks.nearest(index, asked, 0), lambda: blocks.write_blocks(vectors, str(tmp_path / "x"), pivots=0)):
        with pytest.raises(ValueError):
            bad()


def test_share_met_on_the_given_vectors(spark, sf, tmp_path):
    v = catalogue.table(spark, sf, "embeddings")
    index = blocks.write_blocks(v, str(tmp_path / "given"), "vec_id", pivots=64)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    share = blocks.pruning(index, asked, 20).first()
    assert share["queries"] == asked.count() and share["met_blocks"] <= share["pairs"]


def test_search_through_an_index(spark, sf, tmp_path):
    chunks = chunking.chunk_pages(catalogue.corpus_pages(spark, sf)).withColumn("title", F.lit(None).cast("string"))
    chunks = chunks.withColumn("embedding", scoring.embedding_of(F.col("text"), scoring.HashEmbedder())).cache()
    asked = catalogue.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = blocks.write_blocks(chunks, str(tmp_path / "chunks"), keep=("filename",), pivots=32)
    some = F.col("filename").isin(*[r[0] for r in chunks.select("filename").distinct().orderBy("filename").limit(5).collect()])
    whole, through = (search_chunks(chunks, asked, scoring.HashEmbedder(), scoring.OverlapReranker(), where=some, index=i).select("query_id", "position", "citation_id").collect() for i in (None, index))
    assert whole and sorted(map(tuple, whole)) == sorted(map(tuple, through))
