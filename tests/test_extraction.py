"""Blocks, recognition, counters, models and progress on their way through ingestion."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veritide.cli import Application
from veritide.config import EngineConfig
from veritide.functions.models import Labelled, Lazy
from veritide.functions.scoring import HashEmbedder, OverlapReranker, embedding_of, entailment_of
from veritide.operators import layout
from veritide.operators.chunking import chunk_pages, counted_units
from veritide.operators.citations import validate_markers
from veritide.plans.search import search_chunks
from veritide.plans.verify import markers_of
from veritide.sources.files import drafts, extract_pages, recognise_sparse


# --- models in workers


def noisy_factory(log):
    def make(device, size=64):
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {device}\n")
        return HashEmbedder(size)

    return make


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    log = tmp_path / "loads"
    model = Lazy(noisy_factory(str(log)), dimension=64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for _ in range(2):  # the second job finds the workers' models
            rows = spark.range(300, numPartitions=8).select(embedding_of(F.col("id").cast("string"), model, 4).alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = HashEmbedder().embed([str(i) for i in range(300)])
    assert all(abs(a - b) < 1e-12 for r, w in zip(rows, want, strict=True) for a, b in zip(r["v"], w, strict=True))
    loads = log.read_text().split("\n")[:-1]
    assert loads and len(loads) == len({x.split()[0] for x in loads}) and {x.split()[1] for x in loads} == {"cpu"}
    assert model.dimension == 64 and str(os.getpid()) not in {x.split()[0] for x in loads}  # the driver never loaded it


def test_factories_by_name_and_chosen_devices(tmp_path):
    assert Lazy("veritide.functions.scoring:HashEmbedder", dimension=None).dimension == 64
    log = tmp_path / "loads"
    handle = Lazy(noisy_factory(str(log)), device="cuda:3", size=8)
    assert handle.dimension == 8 and handle.embed(["x"]).shape == (1, 8) and log.read_text().count("cuda:3") == 1


def test_labels_in_any_order(spark):
    class Model:
        id2label = {0: "CONTRADICTION", 1: "other", 2: "Entailment", 3: "neutral"}

        def score(self, pairs):
            return [(0.1, 9.0, 0.7, 0.2) for _ in pairs]

    for labels in (None, ["contradiction", "x", "entailment", "NEUTRAL"], {2: "entailment", 0: "contradiction", 3: "neutral"}):
        scorer = Labelled(Model(), labels)
        row = spark.createDataFrame([("a", "b")], "p string, h string").select(entailment_of(F.col("p"), F.col("h"), scorer).alias("s")).first()
        assert list(row["s"]) == [0.7, 0.2, 0.1]
    with pytest.raises(ValueError, match="lack neutral"):
        Labelled(Model(), ["entailment", "contradiction"])
    with pytest.raises(ValueError, match="2 scores"):
        Labelled(type("Short", (), {"score": lambda self, pairs: [(1, 2)]})(), ["entailment", "neutral", "contradiction"]).score([("a", "b")])


def test_a_reranker_must_score_every_pair(spark):
    class Short:
        def score(self, pairs):
            return [1.0] * (len(pairs) - 1)

    from veritide.functions.scoring import pair_score

    with pytest.raises(Exception, match="another number of scores"):
        spark.createDataFrame([("a", "b"), ("c", "d")], "q string, p string").coalesce(1).select(pair_score(F.col("q"), F.col("p"), Short())).collect()


# --- counters


def count(text):
    """Pieces of three letters; long texts count one more, so that counts don't add up."""
    return len(re.findall(r"\w\w?\w?|[^\w\s]", text)) + (len(text) > 40)


def by_force(pages, target):
    def hard(text):
        parts = []
        while text:
            low, high = 1, len(text)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if count(text[:middle]) <= target else (low, middle - 1)
            parts.append(text[:low])
            text = text[low:]
        return parts

    out = []
    for page in pages:
        units = []
        for p in page:
            units += ["".join(p)] if count("".join(p)) <= target else [u for s in p for u in ([s] if count(s) <= target else hard(s))]
        out.append(units)
    return out


def test_units_under_a_counter_by_force():
    rng = random.Random(1)
    word = lambda: rng.choice(["ab ", "abcdef ", ". ", "x", "supercalifragilistic"])
    for _ in range(300):
        pages = [[["".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(4))] for _ in range(3)]
        target = rng.choice([1, 3, 8, 20])
        got = counted_units(pages, target, lambda xs: [count(x) for x in xs])
        assert got == by_force(pages, target)
        assert ["".join(x) for x in got] == ["".join(map("".join, p)) for p in pages]
        assert all(count(u) <= target for units in got for u in units if len(u) > 1)


def test_chunks_stay_within_a_models_count(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    pages = spark.createDataFrame([(f"d{i}", "f.pdf", 1, x, []) for i, x in enumerate(texts)], "document_id string, filename string, page int, text string, headings array<string>")
    rows = chunk_pages(pages, 60, 10, lambda xs: [len(x) // 5 for x in xs]).collect()
    assert max(len(r["text"]) // 5 for r in rows) <= 60 + 20 and len(rows) > 100  # a window's own count may exceed its units' sum by rounding
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["document_id"] == f"d{i}"), key=lambda r: r["chunk_index"])
        assert all(r["text"] in text for r in own) and (not text.strip() or text.startswith(own[0]["text"]) and text.rstrip().endswith(own[-1]["text"].rstrip()))


# --- blocks, recognition, progress


BODY = "A sentence of body text that is quite long, on and on. " * 6


def make_extractor(body):
    """Nested, so that it travels to the workers by value."""

    def extract(name, content):
        kind = content.decode()
        if kind == "bad":
            raise ValueError("unreadable")
        if kind == "scan":
            return [(1, "few words", ["Few"]), (2, "", []), (3, body, [])]
        block = lambda text, size, bold=False: (text, [0.0, 1.0, 2.0, 3.0], size, bold)
        first = [block("Methods", 14.0), block(body, 10.0), block("2. Numbered part", 10.0), block("Bold words", 10.0, True)]
        return [(1, f"Methods\n{body}\n2. Numbered part\nBold words\n{body}", first), (2, body, [block(body, 10.0)])], {"title": "T"}

    return extract


blocks_extractor = make_extractor(BODY)


@pytest.fixture()
def folder(tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    for name in ("laid", "scan", "bad"):
        (docs / f"{name}.pdf").write_text(name)
    return tmp_path


def counting_recogniser(log):
    def recognise(name, content, page):
        with open(log, "a") as f:
            f.write(f"{name} {page}\n")
        if page == 2:
            import time

            time.sleep(60)
        return "recovered text of the scanned page, longer than what was there"

    return recognise


def test_headings_come_from_blocks(spark, folder):
    app = Application(spark, str(folder / "data"), str(folder / "documents"), EngineConfig(chunk_size=30, chunk_overlap=0), extractor=blocks_extractor)
    app.ingest(app.documents).collect()
    rows = app.store.read("chunks").where("filename = 'laid.pdf'").orderBy("chunk_index").collect()
    page, want, section = blocks_extractor("laid.pdf", b"laid")[0][0][1], [], None
    for r in rows:
        for heading in ("Methods", "2. Numbered part", "Bold words"):
            if r["page"] == 1 and page.find(heading) <= page.find(r["text"]):
                section = heading
        want.append(section)
    assert [r["section"] for r in rows] == want and set(want) == {"Methods", "2. Numbered part"} and {r["page_count"] for r in rows} == {2}
    pages = extract_pages(app.listing(), blocks_extractor)
    assert {tuple(r["headings"]) for r in layout.mark_pages(pages.where("filename = 'laid.pdf' and page = 1")).collect()} == {("Methods", "2. Numbered part", "Bold words")}


def test_only_sparse_pages_are_recognised(spark, folder):
    log = folder / "calls"
    app = Application(spark, str(folder / "data"), str(folder / "documents"), extractor=blocks_extractor)
    pages = extract_pages(app.listing(), blocks_extractor).where("error is null").cache()
    began = time.time()
    got = {(r["filename"], r["page"]): r for r in recognise_sparse(pages, app.listing(), counting_recogniser(str(log)), seconds=1.0).collect()}
    assert time.time() - began < 40 and sorted(log.read_text().split("\n")[:-1]) == ["scan.pdf 1", "scan.pdf 2"]
    assert got["scan.pdf", 1]["text"].startswith("recovered") and list(got["scan.pdf", 1]["headings"]) == []
    assert got["scan.pdf", 1]["warning"] == "page 1: 9 characters extracted; replaced by recognised text"
    assert got["scan.pdf", 2]["text"] == "" and got["scan.pdf", 2]["warning"] == "page 2: 0 characters extracted; recognition unavailable"
    assert [got[k]["warning"] for k in (("scan.pdf", 3), ("laid.pdf", 1), ("laid.pdf", 2))] == [None] * 3 and got["laid.pdf", 1]["blocks"]
    none = recognise_sparse(pages, app.listing(), lambda *a: "x").where("page = 1 and filename = 'scan.pdf'").first()
    assert none["text"] == "few words" and none["warning"].endswith("recognition found no more") and list(none["headings"]) == ["Few"]


def test_progress_equals_the_report(spark, folder):
    app, heard = Application(spark, str(folder / "data"), str(folder / "documents"), extractor=blocks_extractor), []
    report = app.ingest(app.documents, lambda step, counts: heard.append((step, counts))).collect()
    assert [s for s, _ in heard] == ["extracted", "embedded", "committed"]
    counts = dict(heard)
    assert counts["extracted"] == {"files": 3, "pages": 5, "failed": 1, "warnings": 2}
    assert counts["embedded"]["chunks"] == sum(r["chunk_count"] for r in report) == counts["committed"]["updated_chunks"] == app.store.read("chunks").count()
    assert {k: counts["committed"][k] for k in ("found", "new", "failed")} == {"found": 3, "new": 2, "failed": 1}
    warnings = {r["source_path"]: list(r["warnings"]) for r in report}
    assert [len(warnings[n]) for n in ("scan.pdf", "laid.pdf", "bad.pdf")] == [2, 0, 0]


def test_ingestion_uses_the_embedders_counter(spark, folder):
    class Counting(HashEmbedder):  # local, so that it travels by value
        def count_tokens(self, texts):
            return [len(x) // 4 for x in texts]

    app = Application(spark, str(folder / "data"), str(folder / "documents"), EngineConfig(chunk_size=40, chunk_overlap=0), Counting(), extractor=blocks_extractor)
    app.ingest(app.documents).collect()
    sizes = [len(r["text"]) // 4 for r in app.store.read("chunks").select("text").collect()]
    assert max(sizes) <= 44 and len(sizes) > 8


# --- refusals and paths


def test_blank_queries_and_empty_results_are_refused(spark):
    chunks = spark.createDataFrame([("c1", "d", "f", "words here", [1.0, 0.0])], "citation_id string, document_id string, fingerprint string, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "words"), (2, "  \t"), (3, None)], "query_id int, query string")
    with pytest.raises(ValueError, match="2 of 3"):
        search_chunks(chunks, asked, HashEmbedder(2), OverlapReranker())
    with pytest.raises(ValueError, match="top_k"):
        search_chunks(chunks, asked.where("query_id = 1"), HashEmbedder(2), OverlapReranker(), top_k=0)
    assert search_chunks(chunks, asked.where("query_id = 1"), HashEmbedder(2), OverlapReranker(), top_k=1).count() == 1


def test_drafts_of_one_name_stay_apart(spark, tmp_path):
    for where in ("a", "b/c"):
        (tmp_path / where).mkdir(parents=True)
        (tmp_path / where / "draft.md").write_text(f"text of {where}")
    assert {r["draft_id"]: r["text"] for r in drafts(spark, str(tmp_path)).collect()} == {"a/draft.md": "text of a", "b/c/draft.md": "text of b/c"}
    assert [r["draft_id"] for r in drafts(spark, str(tmp_path / "a/draft.md")).collect()] == ["draft.md"]


def test_reference_paths_and_pages_beyond_the_document(spark, folder):
    app = Application(spark, str(folder / "data"), str(folder / "documents"), extractor=blocks_extractor)
    app.ingest(app.documents).collect()
    cite = app.store.read("chunks").where("filename = 'laid.pdf' and page = 2").first()["citation_id"]
    assert app.reference(cite)["source_path"] == str(folder / "documents/laid.pdf")
    text = spark.createDataFrame([("d", f"[[REF:{cite}]]")], "draft_id string, text string")
    live, chunks = app.listing().select("source_path", "current_hash"), app.store.read("chunks")
    assert validate_markers(markers_of(text), chunks, live).first()["valid"]
    [issue] = validate_markers(markers_of(text), chunks.withColumn("page_count", F.lit(1)), live).first()["issues"]
    assert issue["failure"] == "INVALID_PAGE"


def test_html_blocks(spark):
    html = (
        "<html><head><title>no</title></head><body><nav>skip <a>me</a></nav><h1>Big &amp; <i>bold</i></h1>after"
        "<p><strong>Strong</strong> start</p><!-- gone --><script>var x = '<p>no</p>';</script><H2 class='x'>Second</H2><p>a &lt;b&gt;&nbsp; c<br>d</p></body></html>"
    )
    rows = layout.html_blocks(spark.createDataFrame([("1", html), ("2", None), ("3", ""), ("4", "plain")], "document_id string, html string")).orderBy("document_id", "pos").collect()
    got = [(r["document_id"], r["text"], r["font_size"], r["bold"]) for r in rows]
    assert got == [
        ("1", "Big & bold", 24.0, False), ("1", "after", 10.0, False), ("1", "Strong start", 10.0, True), ("1", "Second", 20.0, False),
        ("1", "a <b> c", 10.0, False), ("1", "d", 10.0, False), ("4", "plain", 10.0, False),
    ]
    assert [r["headings"] for r in layout.block_pages(layout.html_blocks(spark.createDataFrame([("1", html)], "document_id string, html string"))).collect()] == [["Big & bold", "Strong start", "Second"]]
