"""The jobs on copies of the tables: growing input, repeated and broken runs, and the command line."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from compare import same
from pyspark.sql import functions as F

from jobs import common, index_documents, review_answers
from jobs.queries import oracle_sql, queries

ROOT = Path(__file__).resolve().parents[1]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(queries()))
def test_job_equals_its_sql(spark, sf, name):
    assert len(same(spark, queries()[name], oracle_sql()[name], sf))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("part-*")}


PASSAGE = ("document_id", "document_hash", "filename", "page", "section", "chunk_index", "text", "citation_id", "token_count")


@pytest.fixture
def library(spark, sf, tmp_path):
    """A growing folder of documents and one index over it."""
    table = spark.read.parquet(f"{sf}/documents.parquet")

    class Library:
        documents, output, checkpoint = (str(tmp_path / n) for n in ("documents", "index", "checkpoint"))

        def add(self, rows):
            rows.coalesce(1).write.mode("append").parquet(self.documents)

        def run(self):
            index_documents.run(spark, self.documents, self.output, self.checkpoint)

        def current(self):
            return index_documents.current(spark, self.output)

    out = Library()
    out.table = table
    return out


def test_a_second_run_takes_only_what_is_new(spark, library, tmp_path):
    library.add(library.table.where("doc_id < 60"))
    library.run()
    before, first = files(library.output), rows_of(library.current(), *PASSAGE)
    assert before and {r[0] for r in first} <= {str(i) for i in range(60)}
    library.run()  # nothing new
    assert files(library.output) == before
    changed = library.table.where("doc_id between 10 and 12").withColumn("text", F.concat(F.lit("Corrected edition\n"), "text"))
    emptied = library.table.where("doc_id = 13").withColumn("text", F.lit(""))
    library.add(library.table.where("doc_id between 50 and 89").unionByName(changed).unionByName(emptied))  # 50 to 59 come again unchanged
    library.run()
    after = files(library.output)
    assert before.items() <= after.items()  # what the first run wrote stays as it was
    taken = spark.read.parquet(f"{library.output}/documents").where("batch = 1")
    assert {int(r[0]) for r in taken.select("document_id").collect()} == {10, 11, 12, 13, *range(60, 90)} & {r[0] for r in library.table.select("doc_id").collect()}
    whole = library.table.where("doc_id < 90 and doc_id not between 10 and 13").unionByName(changed).unionByName(emptied)
    whole.write.parquet(str(tmp_path / "whole"))
    index_documents.run(spark, str(tmp_path / "whole"), str(tmp_path / "afresh"), str(tmp_path / "other"))
    assert rows_of(library.current(), *PASSAGE) == rows_of(index_documents.current(spark, str(tmp_path / "afresh")), *PASSAGE)
    assert "Corrected edition" in {r[4] for r in rows_of(library.current(), *PASSAGE)}


def test_a_run_that_breaks_is_made_good(spark, library, monkeypatch):
    library.add(library.table.where("doc_id < 30"))
    real, calls = index_documents.read_if_there, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 2:  # passages are written, the list of documents is not
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(index_documents, "read_if_there", breaks)
    with pytest.raises(Exception, match="lost"):
        library.run()
    assert not Path(library.output, "documents").exists()
    library.run()
    got = rows_of(library.current(), *PASSAGE)
    assert got and len(got) == len(set(got))
    fresh = library.table.where("doc_id < 30").select("doc_id", "text", "source", F.struct(F.lit(1).alias("time"), F.lit("x").alias("path")).alias("file"))
    for _ in range(2):  # the same batch again replaces itself
        index_documents.index_batch(fresh, 0, library.output, index_documents.Config())
        assert rows_of(library.current(), *PASSAGE) == got


def test_rows_without_id_or_text_and_repeats(spark, library):
    rows = [(1, "First line\nbody of it.", "en", "a", 1), (1, "First line\nbody of it.", "en", "a", 1), (2, None, "en", "a", 1), (None, "no id", "en", "a", 1), (3, "x", None, None, 1), (4, "", "en", "a", 0)]
    library.add(spark.createDataFrame(rows, SCHEMA))
    library.run()
    assert rows_of(library.current(), "document_id", "filename", "section", "text") == [("1", "a.txt", "First line", "First line\nbody of it."), ("3", "unknown.txt", None, "x")]
    assert rows_of(spark.read.parquet(f"{library.output}/documents"), "document_id", "passages") == [("1", 1), ("3", 1), ("4", 0)]


def test_reviews_again_with_the_same_result(spark, tmp_path):
    turns = [(1, 0, "user", "Only some are not affected by 12 of them."), (1, 1, "assistant", "All are affected by 13 of them."), (1, 2, "user", None), (2, 0, "system", "")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "in"))
    results = []
    for _ in range(2):
        review_answers.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        results.append(rows_of(review_answers.verdicts(spark, str(tmp_path / "out")), "conv_id", "turn", "verdict", "reason"))
    assert results[0] == results[1] and len(results[0]) == 4
    assert (1, 1, "CONTRADICTED", "evidence lacks exact values: 13") in results[0]
    summary = spark.read.json(str(tmp_path / "out/summary")).collect()
    assert sum(r["turns"] for r in summary) == 4
    review_answers.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), review_answers.Config(roles=["assistant"]))
    assert [r[:2] for r in rows_of(review_answers.verdicts(spark, str(tmp_path / "out")), "conv_id", "turn")] == [(1, 1)]


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"lines_per_page": 3}))
    assert common.read_config(spark, str(path), index_documents.Config).lines_per_page == 3
    path.write_text(json.dumps({"lines": 3}))
    with pytest.raises(ValueError, match="unknown settings: lines"):
        common.read_config(spark, str(path), index_documents.Config)
    for job, kind in ((index_documents, "index_documents"), (review_answers, "review_answers")):
        assert common.read_config(spark, str(ROOT / f"jobs/{kind}.json"), job.Config)
    with pytest.raises(ValueError, match="buckets"):
        index_documents.Config(buckets=0)


def test_command_line(spark, sf, tmp_path):
    done = subprocess.run(
        [sys.executable, "-m", "jobs.index_documents", "--documents", f"{sf}/documents.parquet", "--output", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c"), "--config", "jobs/index_documents.json"],
        cwd=ROOT, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read 200 rows" in done.stderr
    assert index_documents.current(spark, str(tmp_path / "o")).count() > 200


def test_registered_index_of_empty_pages_and_blank_lines(spark, tmp_path):
    """As its SQL has it: an empty page is an empty passage, and blank lines part no units."""
    words = lambda n: " ".join(f"word{i}" for i in range(n))
    texts = ["", "a\n" * 10, "\n\n".join([words(150)] * 4), "\n\n".join([words(300) + ". " + words(200)] * 3), "One line"]
    rows = [(i, x, "en", f"src{i}", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    got = same(spark, queries()["job1_index_documents"], oracle_sql()["job1_index_documents"], str(tmp_path))
    assert (got["token_count"] == 0).sum() == 2
