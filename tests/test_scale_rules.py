"""Plans that must keep their shape at any size."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veritide.operators import retrieval, verdicts
from veritide.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_counts_read_two_columns_and_shuffle_nothing(spark, sf):
    text = plan(catalogue.token_count(spark, sf))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_one_query_is_one_top_k_without_a_shuffle_of_vectors(spark, sf):
    rows = catalogue.table(spark, sf, "embeddings")
    text = plan(retrieval.top_one(rows, [1.0] * 64, 5, "vec_id", where=F.col("label") == 3))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in text


def test_pages_are_cut_without_a_shuffle(spark, sf):
    assert "Exchange" not in plan(catalogue.corpus_pages(spark, sf))


def test_windows_need_no_python_worker(spark, sf):
    assert "Python" not in plan(catalogue.chunk_windows(spark, sf))


def test_verdicts_on_pairs_take_one_python_step(spark, sf):
    pairs = catalogue.answers_with_evidence(catalogue.table(spark, sf, "conversations"))
    assert plan(verdicts.pair_verdicts(pairs, ["conv_id", "turn", "role"])).split("Final Plan")[-1].count("ArrowEvalPython") == 1
    assert plan(catalogue.best_overlap_sentence(spark, sf)).count("ArrowEvalPython") == 1


def test_a_search_of_many_queries_holds_few_scores():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(2000, 8)), rng.normal(size=(3000, 8))
    q, unit = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    batch = pa.record_batch({"id": np.arange(3000), "embedding": pa.array(x.tolist())})
    tracemalloc.start()
    best = retrieval.best_in(q, [batch], 5, "id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.round(q @ unit.T, 9)
    want = np.lexsort((np.broadcast_to(np.arange(3000), score.shape), -score), axis=1)[:, :5]
    assert (best["id"].to_numpy().reshape(2000, 5) == want).all()
    assert peak < 64_000_000


def test_search_reads_chunks_that_are_cut_once(spark, sf):
    text = plan(catalogue.search_end_to_end(spark, sf))
    assert "documents.parquet" not in text and "citation_id" in text
