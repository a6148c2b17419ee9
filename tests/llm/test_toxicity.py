"""Multiple-instance toxicity: scores by force from the model's rows, accuracy on held-out labels, and edge cases."""

import zlib
from math import exp

import pytest
from pyspark.sql import functions as F

from veritide.llm import toxicity as T
from veritide.llm.words import mix

RUDE = ["Nothing to see here.", "You absolute floob of a wugnut!", "The end, said nobody."]


@pytest.fixture(scope="module")
def taught(spark):
    """Documents of ten sentences; the toxic ones hold "wugnut", beside words of their own."""
    rows = [(i, " ".join(f"Plain sentence {i * j} goes on." for j in range(9)) + (" What a wugnut he is!" if i % 4 == 0 else " All is well.")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = T.train(docs, labels)
    return docs, labels, spark.createDataFrame(model.collect(), model.schema)


def by_force(text, model):
    """Noisy-or over sentences, word by word, from the definition."""
    weights, calm, piece, count = dict(model), 1.0, set(), 0

    def close():
        nonlocal calm, piece
        calm *= 1 - 1 / (1 + exp(-(weights[T.BIAS] + sum(weights.get(f, 0) for f in piece))))
        piece = set()

    def places(word):
        raw, h = word.encode(), 0
        import numpy as np

        for k, b in enumerate(raw[: T.LONGEST]):
            h = (h * 0x9E3779B97F4A7C15 + b + 1) % 2**64
            if k + 1 >= T.LEAST:
                yield int(mix(np.array([h], dtype=np.uint64))[0]) >> (64 - T.BITS)
            if k + 1 == len(raw):
                yield int(mix(~np.array([h], dtype=np.uint64))[0]) >> (64 - T.BITS)

    import re

    for sentence in re.findall(T.SENTENCE, text or ""):
        words = re.findall("[a-z0-9]+|[^\x00-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
        assert sentence.isascii()
        for count, word in enumerate(words, 1):
            piece.update(places(word))
            if count % T.PIECE == 0:
                close()
        if words and len(words) % T.PIECE:
            close()
    return 1 - calm


def test_scores_by_force(spark, taught):
    _, _, model = taught
    rows = [tuple(r) for r in model.collect()]
    texts = ["wugnut", "a wugnut. wugnut wugnut!\n\nWUGNUT", "plain " * 500, "x " * 39 + "wugnut wugnut " + "y " * 50, "wugnuts abound", "", "...!?", "No\nstop"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in T.score_documents(docs, model).collect():
        assert r["score"] == pytest.approx(by_force(texts[r["doc_id"]], rows), abs=1e-5)


def test_labels_of_documents_find_the_sentence(spark, taught):
    _, _, model = taught
    text = " ".join(RUDE)
    docs = spark.createDataFrame([(1, text), (2, RUDE[0])], "doc_id bigint, text string")
    scored = T.score_documents(docs, model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got[1] >= T.THRESHOLD > got[2]
    found = T.offending_sentences(scored).collect()
    assert [(r["doc_id"], r["text"].strip()) for r in found] == [(1, RUDE[1])]
    assert text[found[0]["start"] : found[0]["end"]] == found[0]["text"]


def test_offsets_are_code_points(spark, taught):
    docs = spark.createDataFrame([(1, "İé日本 \U0001f600 first. What a wugnut! Ende ß.")], "doc_id bigint, text string")
    [r] = T.offending_sentences(T.score_documents(docs, taught[2])).collect()
    assert docs.first()["text"][r["start"] : r["end"]] == r["text"] == " What a wugnut!"


def test_held_out_labels_teach_nothing(spark, taught):
    docs, labels, model = taught
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(T.train(docs, turned).collect()) == sorted(model.collect())
    want = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    assert {r[0]: r[1] for r in spark.range(50).select("id", T.held_out(F.col("id"))).collect()} == want


def test_the_fit_does_not_depend_on_order(spark, taught):
    docs, labels, model = taught
    assert T.train(docs.orderBy(F.desc("doc_id")).coalesce(3), labels.repartition(5)).collect() == model.collect()


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [[r["score"] for r in rows if r["toxic"] == c] for c in (1, 0)]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) > 0.8 * len(toxic) * len(clean)
    assert sum(s >= T.THRESHOLD for s in clean) <= 0.05 * len(clean) and sum(s >= T.THRESHOLD for s in toxic) > 0.5 * len(toxic)


def test_edge_rows(spark, edge, nothing, taught):
    _, labels, model = taught
    got = T.score_documents(edge, model).collect()
    assert len(got) == edge.count()
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5)) and len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert T.toxicity_digest(nothing, labels).collect() == []
    for empty in (labels.where("false"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        got = T.toxicity_digest(edge, empty).collect()
        assert {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)} and len(got) == edge.count()
    some = labels.where("toxic = 1").unionByName(labels).withColumn("text", F.lit("clash"))
    assert T.train(taught[0].withColumns({"toxic": F.lit(0), "sentences": F.lit("x")}), some).collect() == model.collect()
