import json

import pytest
from pyspark.sql import functions as F

from veritide.cli import Application, main, parser, run
from veritide.config import EngineConfig
from veritide.functions.scoring import HashEmbedder
from veritide.operators import checks, citations, layout, retrieval, store, verdicts
from veritide.operators.claims import extract_claims
from veritide.mcp import serve
from veritide.sources.files import check_path, source_key


def make_extractor(calls):
    def extractor(name, content):  # nested, so that it travels to the workers by value
        if content.startswith(b"broken"):
            raise ValueError("unreadable")
        with open(f"{calls}/{name}", "a") as log:
            log.write("x")
        pages = [(n, text, [text.split("\n")[0]]) for n, text in enumerate(content.decode().split("\f"), 1)]
        return (pages, {"title": " On Sleep ", "author": "Ann Lee; Bo Roe", "creation_date": "D: 2019", "subject": "doi:10.1234/abc.1"}) if name == "one.pdf" else pages

    return extractor


@pytest.fixture()
def app(spark, tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    calls = tmp_path / "calls"
    calls.mkdir()
    (docs / "one.pdf").write_text("Methods\nThe sleep group slept 8 hours. Sleep is associated with recall.\fResults\nRecall rose in 20 of 40 people.")
    (docs / "two.PDF").write_text("Other\nTea may help focus. Coffee was not tested here.")
    (docs / "bad.pdf").write_text("broken")
    return Application(spark, str(tmp_path / "data"), str(docs), extractor=make_extractor(str(calls)))


def test_ingest_search_verify_prune(app, tmp_path, capsys):
    first = {r["source_path"]: r for r in app.ingest(app.documents).collect()}
    assert {k: r["status"] for k, r in first.items()} == {"one.pdf": "new", "two.PDF": "new", "bad.pdf": "failed"}
    assert "unreadable" in first["bad.pdf"]["error"] and first["one.pdf"]["chunk_count"] == 2
    assert {f.name: len(f.read_text()) for f in (tmp_path / "calls").iterdir()} == {"one.pdf": 1, "two.PDF": 1}  # extracted once
    stored = app.store.read("chunks").where("filename = 'one.pdf'").first()
    assert (stored["title"], stored["authors"], stored["year"], stored["doi"]) == ("On Sleep", ["Ann Lee", "Bo Roe"], 2019, "10.1234/abc.1")
    again = {r["source_path"]: r["status"] for r in app.ingest(app.documents).collect()}
    assert again == {"one.pdf": "unchanged", "two.PDF": "unchanged", "bad.pdf": "failed"}
    found = app.search("sleep and recall", top_k=2).collect()
    assert found[0]["filename"] == "one.pdf" and len(found) == 2
    assert {r["filename"] for r in app.search("tea", document_filter="two.PDF").collect()} == {"two.PDF"}
    cite = next(r["citation_id"] for r in found if r["page"] == 1)
    draft = tmp_path / "draft.md"
    draft.write_text(f'The "sleep group" slept 8 hours [[REF:{cite}]]. It slept 9 hours [[REF:{cite}]]. No mark at all in 2020.')
    report = app.verify(str(draft))
    assert [r["verdict"] for r in report.claims.orderBy("claim_pos").collect()][1] == "CONTRADICTED"
    assert report.drafts.first()["failed"] and all(r["valid"] for r in report.structural.collect())
    for command, code in ((["verify", str(draft)], 1), (["revise", str(draft)], 0), (["citations", str(draft)], 0), (["health"], 0), (["list"], 0), (["search", "tea"], 0), (["reference", cite], 0), (["reference", "none-at-all"], 1)):
        assert run(app, parser().parse_args(command)) == code
    assert json.loads((tmp_path / "data/verification/draft.md.revision.json").read_text())["items"]
    (tmp_path / "documents/one.pdf").unlink()
    dry = app.prune(dry_run=True).collect()
    assert [(r["reason"], r["chunk_count"]) for r in dry] == [("missing_source", 2)] == [(r["reason"], r["chunk_count"]) for r in app.prune().collect()]
    assert app.prune().count() == 0 and app.store.read("chunks").count() == 1
    assert app.tools()["get_reference"]("gone") == {"error": "reference not found"}
    capsys.readouterr()


def test_changed_document_keeps_its_id_and_loses_old_chunks(app, tmp_path):
    app.ingest(app.documents).collect()
    before = app.store.read("manifest").where("source_path = 'one.pdf'").first()
    (tmp_path / "documents/one.pdf").write_text("Methods\nNew words only.")
    assert {r["source_path"]: r["status"] for r in app.ingest(app.documents).collect()}["one.pdf"] == "changed"
    after = app.store.read("manifest").where("source_path = 'one.pdf'").first()
    assert before["document_id"] == after["document_id"] and after["chunk_count"] == 1
    assert [r["document_hash"] for r in app.store.read("chunks").where(F.col("document_id") == after["document_id"]).collect()] == [after["document_hash"]]


def test_stream_ingests_once(app, tmp_path, spark):
    from veritide.streaming.ingest import watch

    seen = []
    for _ in range(2):
        watch(app.store, app.documents, app.extractor, app.embedder, str(tmp_path / "ck"), report=lambda f: seen.append(f.count())).awaitTermination(120)
    assert seen == [3] and app.store.read("manifest").count() == 2


def test_config_and_paths(tmp_path):
    for bad in ({"chunk_overlap": 600}, {"result_count": 50}, {"deduplication_threshold": 2}, {"marker_mode": "x"}, {"chunk_size": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    with pytest.raises(FileNotFoundError):
        check_path(tmp_path / "none")
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        check_path(tmp_path / "a.txt")
    assert main(["--data", str(tmp_path), "--documents", str(tmp_path), "ingest", str(tmp_path / "none")]) == 1


def test_markers(spark):
    text = "I prefer [[REF:abc-def]] x\nsee [[REF: ]] and [[REF:ab]] \U0001f600 [[REF:good-id-1]]"
    row = spark.createDataFrame([(text,)], "x string").select(citations.parse_markers(F.col("x")).alias("m"), citations.parse_markers(F.col("x"), "canonical").alias("c")).first()
    assert [text[m["start"] : m["end"]] for m in row["m"]] == [m["raw"] for m in row["m"]]
    assert [m["malformed"] for m in row["m"]] == [True, True, True, False]
    assert [m["citation_id"] for m in row["c"]] == ["abc-def", None, "ab", "good-id-1"]


def test_rules(spark):
    rows = [
        ("It may be 5 cm.", "It is 5 cm long.", ["Ann Lee"]),
        ("X causes Y always.", "X is associated with Y. Z may be.", None),
        ("According to Ann Lee it holds.", "It holds.", ["Lee, A."]),
        ("According to Bob it holds.", "It holds not.", ["Lee, A."]),
        ("«رشد» ۵ درصد بود", "رشد 5 درصد بود", []),
    ]
    got = checks.check_pairs(spark.createDataFrame(rows, "claim string, evidence string, authors array<string>")).collect()
    assert [r["numeric_ok"] for r in got] == [True, None, None, None, True]
    assert list(got[1]["findings"]) == [checks.FINDINGS[0], checks.FINDINGS[1], checks.FINDINGS[2]]
    assert [r["attribution_ok"] for r in got] == [None, None, True, False, None]
    assert got[3]["negation_ok"] is False and got[4]["quote_ok"] is True


def test_verdict_shapes(spark):
    class Opinion:
        def score(self, pairs):
            return [(0.0, 0.1, 0.9) if "fell" in h else (0.9, 0.1, 0.0) for _, h in pairs]

    chunks = spark.createDataFrame([("paper-1_p1", "Recall improved clearly in the evidence.", ["A"])], "citation_id string, text string, authors array<string>")
    drafts = spark.createDataFrame(
        [
            ("supported", "Recall got better [[REF:paper-1_p1]]."), ("contradicted", "Recall fell down [[REF:paper-1_p1]]."),
            ("quoted", 'Recall "improved clearly" there [[REF:paper-1_p1]].'), ("misquoted", 'Recall "worsened badly" there [[REF:paper-1_p1]].'),
        ],
        "draft_id string, text string",
    )
    rows = verdicts.with_model(verdicts.rule_verdicts(verdicts.with_references(extract_claims(drafts), chunks)), Opinion())
    assert {r["draft_id"]: r["verdict"] for r in rows.collect()} == {"supported": "SUPPORTED", "contradicted": "CONTRADICTED", "quoted": "SUPPORTED", "misquoted": "QUOTE_MISMATCH"}


def test_near_duplicates_and_selection(spark):
    rows = [(1, 1, "d", "f1", "same words here"), (1, 2, "d", "f2", "same words here!"), (1, 3, "e", "f3", "same words here"), (1, 4, "d", "f1", "other"), (1, 5, "d", "f5", "quite different")]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, document_id string, fingerprint string, text string")
    kept = retrieval.near_duplicates_out(ranked)
    assert sorted(r["rank"] for r in kept.collect()) == [1, 3, 5]
    assert [r["rank"] for r in retrieval.select_results(kept, 2).orderBy("position").collect()] == [1, 3]
    with pytest.raises(ValueError):
        retrieval.select_results(kept, 0)


def test_top_many_takes_blocks_and_ties(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)] + [(99, None), (98, [0.0, 0.0])], "citation_id int, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0]), (2, None)], "query_id int, embedding array<double>")
    for size in (1, 1 << 20):
        got = retrieval.top_many(vectors, asked, 4, block_bytes=size).orderBy("query_id", "vector_rank").collect()
        assert [(r["query_id"], r["citation_id"]) for r in got] == [(0, 0), (0, 3), (0, 6), (0, 1), (1, 2), (1, 5), (1, 8), (1, 1)]


def test_layout(spark):
    chosen = spark.createDataFrame([("short", "much longer text", True), ("short", "x", True), ("short", None, False), ("y" * 300, "z" * 900, True)], "t string, o string, a boolean")
    got = [r["c"] for r in chosen.select(layout.choose_text(F.col("t"), F.col("o"), F.col("a")).alias("c")).collect()]
    assert [g["replaced"] for g in got] == [True, False, False, False] and got[3]["warning"] is None


def test_upsert_and_embedding(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "citation_id string, v int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 0)], "citation_id string, v int, batch_pos int")
    assert sorted((r[0], r[1]) for r in store.upsert(old, new).collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert abs((HashEmbedder().embed(["abc"]) ** 2).sum() - 1) < 1e-9


def test_embeds_in_batches_of_the_set_size(spark):
    from veritide.functions.scoring import embedding_of

    class Sized:
        dimension = 1

        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    rows = spark.range(10, numPartitions=1).select(embedding_of(F.col("id").cast("string"), Sized(), 4).alias("v")).collect()
    assert [r["v"][0] for r in rows] == [4.0] * 8 + [2.0] * 2


def test_protocol_server():
    import io

    def echo(text, top_k=1):
        if text == "bad":
            raise ValueError("no such text")
        return {"said": text, "k": top_k}

    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "echo", "arguments": {"text": "é", "top_k": 2}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "echo", "arguments": {"text": "bad"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "none"}}, {"jsonrpc": "2.0", "id": 6, "method": "other"},
    ]
    out = io.StringIO()
    serve({"echo": echo}, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None]
    assert got[1]["result"]["tools"][0]["inputSchema"] == {"type": "object", "properties": {"text": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["text"]}
    assert json.loads(got[2]["result"]["content"][0]["text"]) == {"said": "é", "k": 2} and got[3]["result"]["isError"]
    assert [g["error"]["code"] for g in got[4:]] == [-32602, -32601, -32700]


def test_commands_and_models(app, capsys):
    assert run(app, parser().parse_args(["models", "download"])) == 0
    with pytest.raises(SystemExit) as wrong:
        parser().parse_args(["search", "x", "--top-k", "0"])
    assert wrong.value.code == 2
    capsys.readouterr()


def test_existence_and_citations_of_repeated_ids(spark):
    chunks = spark.createDataFrame([("d1", "c1", "b", 1), ("d1", "c1", "a", 2), ("d2", "c2", "x", 1)], "document_id string, citation_id string, text string, page int")
    asked = spark.createDataFrame([("d1",), ("d9",), (None,)], "document_id string")
    assert {r["document_id"]: r["exists"] for r in store.document_exists(asked, chunks).collect()} == {"d1": True, "d9": False, None: False}
    ids = spark.createDataFrame([("c1",), ("c3",)], "__id string")
    assert [(r["__id"], r["ref"]["text"]) for r in citations.first_of_each(chunks.withColumn("source_path", F.lit("s")), ids).collect()] == [("c1", "b")]


def test_listing_keys(spark):
    paths = [("file:/a/docs/x/y.pdf",), ("/a/other/z.pdf",), ("/q.pdf",)]
    got = [r["k"] for r in spark.createDataFrame(paths, "p string").select(source_key(F.col("p"), "/a/docs").alias("k")).collect()]
    assert got == ["x/y.pdf", "../other/z.pdf", "../../q.pdf"]
