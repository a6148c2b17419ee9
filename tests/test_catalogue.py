from collections import defaultdict
from difflib import SequenceMatcher
from hashlib import md5

import pandas as pd
import pytest
import regex
from compare import same
from pyspark.sql import functions as F

from veritide.functions import patterns as p
from veritide.functions import scoring
from veritide.functions import text as citation
from veritide.functions.text import fold
from veritide.operators import chunking, claims, retrieval, verdicts
from veritide.operators.checks import check_pairs
from veritide.plans.catalogue import QUERIES, SQL, _drafts, corpus_pages, marked_turns, turn_pairs
from veritide.plans.verify import verify


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert len(same(spark, QUERIES[name], SQL[name], sf))


@pytest.mark.parametrize("name", ["verdict_cascade", "revision_action", "report_failed", "verdict_histogram"])
def test_drafts_have_one_fault_whatever_their_evidence_negates(spark, tmp_path, name):
    """Evidence with a negation in the quoted sentence, in another one, and without any, for every kind of draft."""
    texts = ["Alpha is no beta. Gamma delta.", "Alpha is beta. Gamma never was delta.", "Alpha is beta. Gamma delta."]
    rows = [(i, texts[i // 42]) for i in range(126)]
    spark.createDataFrame(rows, "item_id bigint, text string").coalesce(1).toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert len(same(spark, QUERIES[name], SQL[name], str(tmp_path)))


def forms(text):
    return fold(text).replace("٬", ",").replace("٫", ".")


def values(text):
    return {forms(m.group()) for pattern in (p.NUMBER, p.DATE, p.STAT) for m in regex.finditer(pattern.replace("(?iu)", "(?i)"), text)}


def test_numeric_check_by_force(spark, sf):
    """Every pair of turns, with the patterns run by another engine."""
    pairs = turn_pairs(spark, sf).collect()
    want = {}
    for r in pairs:
        own, there = values(r["claim"]), values(r["evidence"])
        want[r["conv_id"], r["turn"]] = (not own - there if own else None, ", ".join(sorted(own - there)))
    assert {(r["conv_id"], r["turn"]): (r["numeric_ok"], r["missing"]) for r in QUERIES["numeric_check"](spark, sf).collect()} == want
    made = [("5 cm, 12% and 1,234.5", "12 % of 5"), ("n = 20 in 2019", "n=20 in 2019"), ("p < 0.05 of 3x", "p<0.05"), ("۱۲٫۵ درصد", "12.5 درصد"), ("x-5 +7 -8", "5 and -8"), ("none", "9")]
    rows = check_pairs(spark.createDataFrame(made, "claim string, evidence string"), mode="canonical").collect()
    forced = {c: (not values(c) - values(e) if values(c) else None, sorted(values(c) - values(e))) for c, e in made}
    assert {r["claim"]: (r["numeric_ok"], list(r["missing"])) for r in rows} == forced
    assert {x for x, _ in forced.values()} == {True, False, None}


def test_claims_cover_their_drafts(spark, sf):
    """Claims are places of their draft, in order and apart, and none of a draft's words lies outside them."""
    drafts = {f"{r['conv_id']}-{r['turn']}": r["text"] for r in marked_turns(spark, sf).collect()}
    found = defaultdict(list)
    for r in QUERIES["claim_extract"](spark, sf).collect():
        found[r["draft_id"]].append(r)
    for draft, text in drafts.items():
        rows = sorted(found[draft], key=lambda r: r["claim_pos"])
        assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:], strict=False))
        for r in rows:
            assert md5(text[r["start"] : r["end"]].encode()).hexdigest() == r["text_md5"]
        inside = {i for r in rows for i in range(r["start"], r["end"])}
        assert not regex.search(r"\w", "".join(c for i, c in enumerate(text) if i not in inside))


def ratio(new, old):
    return SequenceMatcher(None, new, old).ratio()


def kept_by_force(rows):
    """rows (document, fingerprint, text) in rank order: places of those that repeat no kept one of their document."""
    kept = []
    for i, (doc, mark, text) in enumerate(rows):
        if not any(rows[k][0] == doc and (rows[k][1] == mark or ratio(text, rows[k][2]) >= 0.9) for k in kept):
            kept.append(i)
    return kept


def test_near_duplicates_by_force(spark, sf):
    """Kept and dropped rows of all conversations, and of made ones with ties, equal fingerprints and near copies."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    made = []
    for conv in (-1, -2):
        text = "The quick brown fox jumps over the lazy dog, again and again."
        parts = [text, text, text.replace("fox", "cat"), text.upper(), text[:40], "", "", text + " x" * 12, text[::-1]]
        made += [(conv, i, ("user", "assistant")[(i + conv) % 2], x) for i, x in enumerate(parts)]
    rows = turns.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(spark.createDataFrame(made, "conv_id bigint, turn int, role string, text string"))
    ranked = rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("document_id"), F.sha2("text", 256).alias("fingerprint"), "text")
    got = {(r["query_id"], r["rank"]) for r in retrieval.near_duplicates_out(ranked).collect()}
    by_query = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["turn"]):
        by_query[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    want = {(q, found[i][0]) for q, found in by_query.items() for i in kept_by_force([(role, text, text) for _, role, text in found])}
    assert got == want and len(want) < rows.count()
    assert {tuple(r)[:2] for r in QUERIES["near_duplicate_dedupe"](spark, sf).collect()} == {w for w in want if w[0] >= 0}


def test_search_end_to_end_by_force(spark, sf):
    """Every benchmark item against every chunk: cosine, rerank, near copies and diversity, step by step in plain Python."""
    chunks = chunking.chunk_pages(corpus_pages(spark, sf)).select("citation_id", "document_id", "fingerprint", "text").collect()
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    embedder, reranker = scoring.HashEmbedder(), scoring.OverlapReranker()
    stored, queries = embedder.embed([c["text"] for c in chunks]), embedder.embed([q["text"] for q in asked])
    want = {}
    for q, vector in zip(asked, queries, strict=True):
        best = sorted((-round(float(v @ vector), 9), c["citation_id"], i) for i, (v, c) in enumerate(zip(stored, chunks, strict=True)))[:20]
        scores = reranker.score([(q["text"], chunks[i]["text"]) for *_, i in best])
        order = [best[k][2] for k in sorted(range(len(best)), key=lambda k: (-scores[k], k))]
        by_id = {best[k][2]: scores[k] for k in range(len(best))}
        unique = [order[k] for k in kept_by_force([(chunks[i]["document_id"], chunks[i]["fingerprint"], chunks[i]["text"]) for i in order])]
        first = [i for n, i in enumerate(unique) if chunks[i]["document_id"] not in {chunks[j]["document_id"] for j in unique[:n]}]
        chosen = (first + [i for i in unique if i not in first])[:5]
        want[q["item_id"]] = [(chunks[i]["citation_id"], round(by_id[i], 6)) for i in chosen]
    got = defaultdict(list)
    for r in QUERIES["search_end_to_end"](spark, sf).orderBy("query_id", "position").collect():
        got[r["query_id"]].append((r["citation_id"], r["relevance_score"]))
    assert got == want


def test_verdicts_with_a_model_by_force(spark, sf):
    """The cascade with models that see entailment and contradiction: every open claim scored sentence by sentence in plain Python."""

    class Contrary:  # local, so that it travels by value
        def score(self, pairs):
            return [(0.9, 0.1, 0.0) if len(p) % 3 == 0 else (0.0, 0.2, 0.8) if len(p) % 3 == 1 else (0.3, 0.6, 0.1) for p, _ in pairs]

    drafts, chunks = _drafts(spark, sf)
    ruled = verdicts.rule_verdicts(verdicts.with_references(claims.extract_claims(drafts), chunks)).collect()
    seen = set()
    for scorer in (scoring.OverlapEntailment(), Contrary()):
        want = {}
        for r in ruled:
            if r["verdict"] is not None:
                want[r["draft_id"], r["claim_pos"]] = (r["verdict"], r["confidence"], tuple(r["reasons"]))
                continue
            parts = [x.strip() for x in regex.split(r"(?<=[.!?؟])\s+", r["combined"]) if len(x.strip()) > 8]
            parts = parts if len(parts) > 1 else [r["combined"]]
            found = scorer.score([(x, r["plain"]) for x in parts])
            e, c = max(found, key=lambda x: x[0]), max(found, key=lambda x: x[2])
            entails, _, contradicts = c if c[2] >= e[0] else e
            if contradicts >= 0.7:
                verdict, why = "CONTRADICTED", ["local NLI estimates contradiction"]
            elif entails >= 0.7 and not r["findings"]:
                verdict, why = "SUPPORTED", ["local NLI estimates entailment"]
            elif r["findings"]:
                verdict, why = "PARTIALLY_SUPPORTED", list(r["findings"])
            else:
                verdict, why = "UNSUPPORTED", ["local NLI does not estimate entailment"]
            want[r["draft_id"], r["claim_pos"]] = (verdict, "HIGH" if verdict in ("CONTRADICTED", "SUPPORTED") else "MEDIUM", (*r["passed"], *why))
        rows = verdicts.with_model(spark.createDataFrame(ruled, verdicts.rule_verdicts(verdicts.with_references(claims.extract_claims(drafts), chunks)).schema), scorer).collect()
        assert {(r["draft_id"], r["claim_pos"]): (r["verdict"], r["confidence"], tuple(r["reasons"])) for r in rows} == want
        seen |= {v[0] for v in want.values()}
        if not isinstance(scorer, Contrary):
            got = {r["draft_id"]: (r["verdict"], r["reason"]) for r in QUERIES["verdict_with_model"](spark, sf).collect()}
            assert got == {d: (v, "; ".join(why)) for (d, _), (v, _, why) in want.items()}
    assert seen >= {"CONTRADICTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "QUOTE_MISMATCH", "SUPPORTED"}


ENDS, CLOSERS = ".!?؟؛。！？", "\"'»”)"


def claims_by_force(text):
    """(start, end, paragraph, claim) of a draft, character by character."""
    cuts, i = [], 0
    while i < len(text):
        j = i
        if i and text[i - 1] in ENDS:
            while j < len(text) and text[j] in CLOSERS:
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            if k > j:
                cuts.append((i, k))
                i = k
                continue
        if text[i] == "\n":
            k = i
            while k < len(text) and text[k] == "\n":
                k += 1
            cuts.append((i, k))
            i = k
            continue
        i += 1
    out, begin, lines = [], 0, 0
    for a, b in [*cuts, (len(text), len(text))]:
        words = text[begin:a].rstrip().rstrip(".").lower().split()
        if (a, b) != (len(text), len(text)) and words and (words[-1] in p.ABBREVIATIONS or " ".join(words[-2:]) in p.ABBREVIATIONS):
            continue
        claim = text[begin:a].strip()
        if claim:
            start = begin + text[begin:a].index(claim)
            out.append((start, start + len(claim), lines, claim))
        lines, begin = lines + text[a:b].count("\n"), b
    return out


MADE = [
    "Smith et al. found it. It holds, e.g. here. See Fig. 2 and vol. 3!  Yes.\n\nNew paragraph: \"quoted.\" After it (so.) end",
    "Dr. No came. No.\nOne line\n\n\nafter three. \u00abنقل.\u00bb بعد؟ بله", "", "   \n ", "no end", "Ends.\u00a0Next. \u3000Last。次 one！ two",
]


def test_claims_by_force(spark, sf):
    """Boundaries, paragraphs, texts, ids and classes of all drafts, and of made ones with abbreviations, quotations and other scripts."""
    drafts = [(f"{r['conv_id']}-{r['turn']}", r["text"]) for r in marked_turns(spark, sf).collect()]
    drafts += [(f"made-{i}", f"{x} [[REF:good-id-{i}]] [[REF:ab]] [[REF:good-id-{i}]]") for i, x in enumerate(MADE)] + [(f"bare-{i}", x) for i, x in enumerate(MADE)]
    rows = claims.extract_claims(spark.createDataFrame(drafts, "draft_id string, text string")).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["claim_pos"]):
        got[r["draft_id"]].append((r["start"], r["end"], r["paragraph"], r["text"]))
    want = {d: claims_by_force(x) for d, x in drafts}
    assert got == {d: w for d, w in want.items() if w}
    for r in rows:
        sound = regex.findall(r"\[\[REF:\s*([A-Za-z0-9][A-Za-z0-9._:-]{5,127})\s*\]\]", r["text"], regex.I)
        assert list(r["citation_ids"]) == list(dict.fromkeys(sound))
        if r["citation_ids"] and len(r["text"].split()) >= 13:
            assert r["claim_type"] in ("LITERATURE_CLAIM", "PROCEDURAL")
    found = {(r["draft_id"], r["start"], r["end"]): md5(r["text"].encode()).hexdigest() for r in rows}
    assert all(found[r["draft_id"], r["start"], r["end"]] == r["text_md5"] for r in QUERIES["claim_extract"](spark, sf).collect())


def test_the_four_kinds_of_drafts(spark):
    """A supported and a contradicted paraphrase, an exact and an altered quotation: verdicts and whether each draft fails, strictly and not."""

    class Opinion:  # local, so that it travels by value
        def score(self, pairs):
            return [(0.05, 0.05, 0.9) if "worse" in h else (0.9, 0.08, 0.02) for _, h in pairs]

    text = "Recall improved clearly after eight hours of sleep. Coffee was part of this trial as well."
    base = spark.createDataFrame([("d-1", "h1", "s.pdf", "s.pdf", 1, text)], "document_id string, document_hash string, source_path string, filename string, page int, text string")
    mark = citation.fingerprint(F.col("document_id"), F.col("page"), F.col("text"))
    chunks = base.withColumns({"fingerprint": mark, "citation_id": F.lit("paper-1_p1"), "authors": F.array(F.lit("Ann Lee"))})
    listing = base.select("source_path", F.col("document_hash").alias("current_hash"))
    drafts = spark.createDataFrame(
        [
            ("supported", "Sleep helps people to recall more afterwards [[REF:paper-1_p1]]."), ("contradicted", "Sleep makes recall worse in people afterwards [[REF:paper-1_p1]]."),
            ("quoted", 'Recall "improved clearly" after sleep [[REF:paper-1_p1]].'), ("misquoted", 'Recall "declined clearly" after sleep [[REF:paper-1_p1]].'), ("empty", ""),
        ],
        "draft_id string, text string",
    )
    for strict in (False, True):
        report = verify(drafts, chunks, listing, Opinion(), strict=strict)
        assert {r["draft_id"]: r["verdict"] for r in report.claims.collect()} == {"supported": "SUPPORTED", "contradicted": "CONTRADICTED", "quoted": "SUPPORTED", "misquoted": "QUOTE_MISMATCH"}
        assert {r["draft_id"]: r["failed"] for r in report.drafts.collect()} == {"supported": False, "contradicted": True, "quoted": False, "misquoted": True, "empty": False}
        assert all(r["valid"] for r in report.structural.collect())
    assert {r["draft_id"]: r["failed"] for r in verify(drafts, chunks, listing, strict=True).drafts.collect()}["supported"]


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    """Documents with empty pages, alone and behind others, and with blank lines on pages of more than one window."""
    words = lambda n, x="word": " ".join(f"{x}{i}" for i in range(n))
    ten = "\n".join(f"Line {i}." for i in range(10))
    texts = ["", f"{ten}\n", f"{ten}\n{ten}\n", f"{ten}\n{chr(10) * 9}", "\n\n", " ", "\n\n".join(words(150) for _ in range(4)), "\n\n".join(words(300) + ". " + words(200) for _ in range(3)), words(900), "One line."]
    folder = tmp_path_factory.mktemp("odd")
    rows = {"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [f"src{i % 7}" for i in range(len(texts))], "n_chars": [len(x) for x in texts]}
    pd.DataFrame(rows).to_parquet(folder / "documents.parquet")
    return str(folder)


def test_units_of_empty_pages_and_blank_lines(spark, odd_pages):
    assert len(same(spark, QUERIES["unit_table"], SQL["unit_table"], odd_pages)) == 14


def test_windows_of_empty_pages_and_blank_lines(spark, odd_pages):
    got = same(spark, QUERIES["chunk_windows"], SQL["chunk_windows"], odd_pages)
    assert (got["tokens"] == 0).sum() == 3


def test_sections_of_empty_pages_and_blank_lines(spark, odd_pages):
    assert len(same(spark, QUERIES["chunk_sections"], SQL["chunk_sections"], odd_pages)) == 21
