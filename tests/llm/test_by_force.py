"""Whole queries over whole tables against plain Python: line dedup, decontamination, verdicts of the URL filter, the pipeline."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_documents import hosts_by_force, quality_by_force, split
from test_others import models_by_force, parts, score_by_force, verdict_by_rule

import corpus_pipeline
from veritide.llm import decontam, lines, quality, queries, urls


def line_sets(texts):
    """Character shingles of every line with a word, by (doc_id, place)."""
    out = {}
    for i, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            if split(line):
                out[i, k] = frozenset(line[j : j + lines.SHINGLE] for j in range(max(1, len(line) - lines.SHINGLE + 1)))
    return out


def least_linked(sets, percent):
    """The smallest key linked with each key of sets, by Jaccard of percent or more; all pairs that share an element are compared."""
    places = defaultdict(list)
    for place, s in sets.items():
        places[s].append(place)
    distinct = sorted(places, key=lambda s: min(places[s]))
    by_element, root = defaultdict(list), list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, s in enumerate(distinct):
        shared = Counter(m for g in s for m in by_element[g])
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(distinct[m]) - both):
                a, b = sorted((find(n), find(m)))
                root[b] = a
        for g in s:
            by_element[g].append(n)
    return {place: min(places[distinct[find(n)]]) if s else place for n, s in enumerate(distinct) for place in places[s]}


def repeated(texts):
    """(doc_id, place) of the lines that go."""
    return {place for place, least in least_linked(line_sets(texts), lines.PERCENT).items() if place != least}


def test_line_dedup_of_documents_equals_all_pairs(spark, sf):
    """Every two lines that share a shingle are compared; what the bands of the operator miss would show as missing."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    gone = Counter(i for i, _ in repeated(rows))
    got = {r["doc_id"]: r["n_removed"] for r in queries.op10_line_dedup(spark, sf).select("doc_id", "n_removed").collect()}
    assert got == {i: gone[i] for i, _ in rows} and sum(gone.values()) > 50


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def matches(docs, items):
    """(doc_id, item_id) to covered words. Pairs whose shared runs of four words could reach the threshold are tiled on whole texts; others cannot reach it."""
    number = defaultdict(lambda: len(number))
    coded = lambda words: [number[w] for w in words]
    k, out = decontam.LEAST, {}
    items = {b: split(low(x)) for b, x in items.items()}
    for d, text in ((d, split(low(x))) for d, x in docs.items()):
        seeds = {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}
        for b, item in items.items():
            within = {j + x for j in range(len(item) - k + 1) if tuple(item[j : j + k]) in seeds for x in range(k)}
            if within and 100 * len(within) >= decontam.PERCENT * len(item):
                covered = sum(n for *_, n in decontam.tile(coded(text), coded(item)))
                if 100 * covered >= decontam.PERCENT * len(item):
                    out[d, b] = covered
    return out


def texts_of(spark, sf, name, key):
    return {r[key]: r["text"] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()}


def test_decontamination_equals_tiling_of_whole_texts(spark, sf):
    want = matches(texts_of(spark, sf, "documents", "doc_id"), texts_of(spark, sf, "benchmark", "item_id"))
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in queries.op1_decontamination(spark, sf).collect()}
    assert got == want and want


def test_pipeline_by_force(spark, sf, tmp_path):
    """All five stages in plain Python, on whole texts. Only which soft rule a document fails is taken from the measures, which have tests of their own.

    Line dedup leaves no near copies in the given documents, so twenty of them come a second time with all lines joined to one.
    """
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{sf}/documents.parquet")
    joined = given.where("doc_id < 20").withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.translate("text", "\n", " ")})
    given.unionByName(joined).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    host = {r["doc_id"]: r["source"] or "" for r in docs.collect()}
    soft = {r["doc_id"]: [r[x] for x in quality.SOFT] for r in quality.document_measures(docs).collect()}
    counts = {}
    for i, h in host.items():
        n, failed = counts.get(h, (0, [0] * len(quality.SOFT)))
        counts[h] = (n + 1, [a + b for a, b in zip(failed, soft[i], strict=True)])
    bad = hosts_by_force(counts)
    kept = {i: x for i, x in text.items() if not quality_by_force(x)[-1] and not any(fails and rule in bad[host[i]] for fails, rule in zip(soft[i], quality.SOFT, strict=True))}
    gone = repeated(kept.items())
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in kept.items()}
    words = {i: split(low(t)) for i, t in cut.items()}
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for i, w in words.items()}
    least = least_linked(sets, 75)
    single = {i: t for i, t in cut.items() if least[i] == i}
    leaks = {i for i, _ in matches(single, texts_of(spark, sf, "benchmark", "item_id"))}
    library = Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    library.no_padding()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i in single.keys() - leaks:
        ids = library.encode(single[i], add_special_tokens=False).ids
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(kept) < len(text) and gone and len(single) < len(cut) and leaks
    assert got == want


def test_url_verdicts_by_force(spark, sf):
    """Scores, the threshold from held-out folds and every verdict of the whole table."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    split_urls = {r["page_id"]: parts(r["url"]) for r in pages}
    said = {i: verdict_by_rule(*p)[1] for i, p in split_urls.items()}
    keyed = spark.createDataFrame([(i, *p) for i, p in split_urls.items()], "page_id bigint, host string, path string")
    fold = {r[0]: r[1] for r in keyed.select("page_id", F.pmod(F.xxhash64("host", "path"), F.lit(2))).collect()}
    text = {i: "".join(p) for i, p in split_urls.items()}
    labelled = [i for i in text if said[i]]
    without = {f: models_by_force([(text[i], said[i]) for i in labelled if fold[i] != f]) for f in (0, 1)}
    held = [(score_by_force(without[fold[i]], text[i]), said[i]) for i in labelled]
    width = 2 * urls.SPAN / urls.BINS
    place = lambda s: min(max(math.floor((s + urls.SPAN) / width), 0), urls.BINS - 1)
    size = Counter(v for _, v in held)
    assert min(size["allow"], size["block"]) > 0

    def balanced(edge):
        right = Counter(v for s, v in held if (place(s) >= edge) == (v == "allow"))
        return right["allow"] / size["allow"] + right["block"] / size["block"]

    quality = [balanced(b) for b in range(urls.BINS)]
    top = [b for b, x in enumerate(quality) if x == max(quality)]
    limit = top[len(top) // 2] * width - urls.SPAN
    models, checked = models_by_force([(text[i], said[i]) for i in labelled]), Counter()
    for r in queries.op9_url_filter(spark, sf).collect():
        i = r["page_id"]
        if said[i]:
            assert r["verdict"] == said[i]
            continue
        score = score_by_force(models, text[i]) if text[i] else None
        if score is not None:
            assert r["score"] == pytest.approx(score, abs=1e-9)
        want = "allow" if score is None or score >= limit else "block"
        assert r["verdict"] == want or abs(score - limit) < 1e-9
        checked[want] += 1
    assert sum(checked.values()) + len(labelled) == len(pages)
