"""Archives, URLs, chats and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import pytest
import zstandard
from compare import same

import corpus_pipeline
from veritide.llm import chat, queries, urls, warc
from veritide.llm.cluster import fresh_path


def test_archives(spark, sf):
    big = "é" * 700
    rows = [(1, "http://a/x y", big), (2, None, big), (5, "u", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "z" * 999), (9, "u", "z" * 999), (8, "again", "other")]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id bigint, url string, html string, digest int, refers_to string").repartition(3)
    got = warc.warc_round_trip(pages).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    shown = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i in (1, 2) else "response", 5 if i in (1, 2) else None) for i, _, h in rows)
    assert shown == want
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    same(spark, queries.op5_warc_round_trip, warc.ORACLE_SQL, sf)


def test_reader_trusts_nothing(spark, tmp_path):
    content = warc.train([b"abc"])
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True).compress
    body = b"<html>"
    good = warc.record(1, "u", body, hashlib.sha1(body).hexdigest(), "response", None)
    head = warc.skippable(content)
    assert [warc.parse(d)[0] for d in warc.read_archive(head + pack(good) + warc.SEPARATOR.encode() + pack(good))] == [1, 1]
    packed_dict = warc.skippable(zstandard.ZstdCompressor().compress(content))
    assert len(list(warc.read_archive(packed_dict + pack(good)))) == 1
    for bad in (good.replace(b"WARC/1.1", b"XARC/1.1"), good.replace(b"Content-Length: 6", b"Content-Length: 7"), good[:-1], good.replace(b"sha1:", b"sha1:0"), good.replace(b"response\r\nWARC-R", b"resource\r\nWARC-R"), good.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    for bad in (pack(good), head[:-2], head + pack(good)[:-3], head + b"12345678", head + pack(good)[:12]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    (tmp_path / "a").write_bytes(head + pack(good) + pack(good[:-1]) + pack(good)[:-3])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["error"] is None for r in got] == [True, False, False]


def verdict_by_rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def test_url_rules(spark, sf):
    odd = [None, "", "no scheme", "://", "http://A.Example.COM/en/71?x", "http://example.com/en/", "http://notexample.com/en/7", "http://com/en/x", "http://x.net/de/8", "http://a.example.net/de/81", "http://É.org/es/#f", "a://b://c/d", "http://h?q/en/", "x\n://com/en/\n"]
    rows = [(i, u, "h") for i, u in enumerate(odd)] + [(i + 100, r["url"], "h") for i, r in enumerate(spark.read.parquet(f"{sf}/pages.parquet").collect())]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).collect()}
    for i, u, _ in rows:
        host, path = parts(u)
        rule, said = verdict_by_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == said if said else got[i]["verdict"] in ("allow", "block")
    assert got[0]["verdict"] == got[3]["verdict"] == "allow"
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    alone = urls.judge_urls(spark.createDataFrame([(1, "http://a.com/en/1"), (2, "http://b.fr/x")], "page_id bigint, url string"))
    assert {r["page_id"]: r["verdict"] for r in alone.collect()} == {1: "block", 2: "allow"}


def test_url_model_on_urls_it_has_not_seen(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
    good, bad = (lambda tld: f"http://{word('aeilmnorst')}.{tld}/de/{word('aeilmnorst')}"), (lambda tld: f"http://{word('xzqkvjw')}.{tld}/es/{word('xzqkvjw')}")
    rows = [(i, (good("net") if i % 2 else bad("org"))) for i in range(400)] + [(1000 + i, (good("info") if i % 2 else bad("info"))) for i in range(200)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    right = sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(200))
    assert right >= 190


def models_by_force(labelled):
    """Exact counts of (order, context, next) and (order, context) by verdict."""
    out = {}
    for want in ("allow", "block"):
        pair, context = out[want] = Counter(), Counter()
        for t, said in labelled:
            for c, x in steps(t) if said == want else ():
                for order in range(urls.ORDERS):
                    pair[order, c[len(c) - order :], x] += 1
                    context[order, c[len(c) - order :]] += 1
    return out


def score_by_force(models, text):
    """Difference of the mean log-likelihoods."""
    total = {}
    for want, (pair, context) in models.items():
        total[want] = 0
        for c, x in steps(text):
            p = 1 / 256
            for order in range(urls.ORDERS):
                key = (order, c[len(c) - order :])
                p = (pair[(*key, x)] + urls.SMOOTHING * p) / (context[key] + urls.SMOOTHING)
            total[want] += math.log(p)
    return (total["allow"] - total["block"]) / len(steps(text))


def steps(text):
    padded = [-1] * (urls.ORDERS - 1) + list(text.encode()) + [0]
    return [(tuple(padded[i : i + urls.ORDERS - 1]), padded[i + urls.ORDERS - 1]) for i in range(len(text.encode()) + 1)]


def test_url_scores_past_65536_grams(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"http://{word(20)}.{'net/de' if i % 2 else 'org/es'}/{word(20)}") for i in range(4000)] + [(9000 + i, f"http://{word(12)}.info/{word(12)}é") for i in range(20)] + [(9100, rows_url := "http://x.info/"), (9101, rows_url)]
    labelled = [("".join(parts(u)), verdict_by_rule(*parts(u))[1]) for i, u in rows if i < 9000]
    assert len({(c, x) for t, _ in labelled for c, x in steps(t)}) > 65_536
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(got) == len(rows)
    models = models_by_force(labelled)
    for i, u in rows[4000:]:
        assert got[i]["score"] == pytest.approx(score_by_force(models, "".join(parts(u))), abs=1e-9)


def test_perspectives(spark, sf):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, None, "me"), (1, 3, None, "me"), (2, None, "ann", "x"), (3, 0, "system", "only"), (4, 600, "ann", "late"), (4, 0, "bob", ""), (None, 0, "ann", "lost")]
    frame = spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = chat.rotate_perspectives(frame).collect()
    assert sorted((str(r["conv_id"]), r["part"], r["speaker"]) for r in got) == sorted(
        [("1", 0, "ann"), ("1", 0, "bob"), ("1", 0, "unknown"), ("2", -1, "ann"), ("4", 0, "ann"), ("4", 0, "bob"), ("4", 2, "ann"), ("4", 2, "bob"), ("None", 0, "ann")]
    )
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s]
        mine = sorted(((t if t is not None else -1), x or "") for c, t, who, x in rows if c == r["conv_id"] and (who or "unknown") == r["speaker"] and (-1 if t is None else t // 256) == r["part"])
        assert [r["rendered"][a:b] for a, b in spans] == [x + chat.CLOSE for _, x in mine]
        assert r["masked_chars"] == sum(b - a for a, b in spans) and r["n_masked"] == len(spans)
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0
    same(spark, queries.op7_chat_perspectives, chat.ORACLE_SQL, sf)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, leaks = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in queries.op1_decontamination(spark, sf).collect()}
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "test-stage")
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        now = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert now <= ids and (name != "line dedup" or now == ids)
        if name == "benchmark decontamination":
            assert not leaks & now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == columns
        ids = now
    assert len(ids) > 100
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert whole == sorted(map(tuple, at.collect()))


def test_pipeline_on_an_empty_table_and_nulls(spark, sf):
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "few words", "en", "s", 9)]):
        at = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        for _, stage in corpus_pipeline.STAGES:
            at = spark.createDataFrame((out := stage(spark, at, sf)).collect(), out.schema)
        assert at.count() == 0


def test_line_stage_keeps_columns_of_the_operators_names(spark, sf):
    docs = spark.createDataFrame([(1, "a line\na line", 7, 8), (2, "a line\nother", 9, 10)], "doc_id bigint, text string, n_lines int, n_removed int")
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a line", 7, 8), (2, "other", 9, 10)]
