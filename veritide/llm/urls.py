"""URL filters: rules first, then a character language-model ratio.

URLs that a rule judges are the labelled rows. Two variable-order Markov models over the characters
of host and path, one of accepted and one of rejected URLs, count all of them; each order backs off
to the one below by additive smoothing. A URL without a rule is accepted when its length-normalised
log-likelihood difference reaches a threshold calibrated on held-out scores: each of two folds is
scored by the models of the other, and the threshold is the one of best balanced accuracy.

Counts are exact rows of a distributed table, one for each distinct gram (an order-4 context and the
next character, packed into 45 bits), so they grow with the corpus and nothing collides. The lower orders are
sums over grams with the same end. Each gram gets its log-likelihood differences once; blocks of about
BLOCK distinct URLs fetch those of their grams by a join. The driver gets a histogram of BINS bins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.llm.cluster import cut
from veritide.llm.space import grouped

ORDERS, SMOOTHING, BINS, SPAN, BLOCK, WIDTH = 5, 0.5, 400, 4.0, 1000, 9
SUMS = ("b0", "a0", "b1", "a1")  # block and allow by fold
SCORES = ("s0", "s1", "s")  # of the models without fold 0, without fold 1, and of all
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Between the first "://" and "/", "?", "#" or the end; A-Z lower-cased. Empty for null or without "://"."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, A_TO_Z, A_TO_Z.lower())


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end. Empty for null or without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of each byte and of the end of each text: WIDTH bits a character, its context above it; 0 lies before the text."""
    raw = texts.cast(pa.binary()).fill_null(b"").to_pylist()
    sizes = np.array([len(x) + 1 for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(x + b"\x00" for x in raw), dtype=np.uint8).astype(np.int64) + 1
    row = np.repeat(np.arange(len(raw)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(data))
    out = data.copy()
    for back in range(1, ORDERS):
        before = at - back
        out |= np.where(before >= first, data[np.maximum(before, 0)], 0) << (WIDTH * back)
    return row, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label, fold, n) to sums by gram, a batch at a time; label is null where no rule says."""
    for batch in batches:
        row, gram = grams(batch.column(0))
        label, fold, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        found, place = np.unique(gram, return_inverse=True)
        sums = []
        for f in (0, 1):
            for c in (0, 1):
                weight = np.where((label == c) & (fold == f), n, 0)[row]
                sums.append(pa.array(np.bincount(place, weights=weight, minlength=len(found)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(found), *sums], names=["gram", *SUMS])


def gram_scores(texts: DataFrame) -> DataFrame:
    """(gram, s0, s1, s): log-likelihood differences of every gram of texts (text, label, fold, n)."""
    counts = texts.select("text", "label", "fold", "n").mapInArrow(_count, "gram bigint, " + ", ".join(f"{c} bigint" for c in SUMS))
    out = cut(counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in SUMS]))
    total = lambda name, by=None: [(F.sum(c).over(by) if by is not None else F.sum(c)).alias(f"{name}_{c}") for c in SUMS]
    base = out
    for order in range(ORDERS):
        for name, key in (
            (f"c{order}", F.shiftright("gram", WIDTH).bitwiseAND(F.lit((1 << WIDTH * order) - 1))),
            (f"p{order}", F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (order + 1)) - 1))),
        ):
            if name == f"p{ORDERS - 1}":
                out = out.select("*", *[F.col(c).alias(f"{name}_{c}") for c in SUMS])
            elif name in ("c0", "p0", "c1", "p1", "c2"):  # 66,049 keys at most, each of many grams
                small = base.groupBy(key.alias("k")).agg(*total(name))
                out = out.withColumn("k", key).join(F.broadcast(small), "k").drop("k")
            else:  # keys of at most 66,049 grams each
                out = out.withColumn("k", key).select("*", *total(name, Window.partitionBy("k"))).drop("k")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in batch.schema.names if n != "gram"}
            found = []
            for folds in ((1,), (0,), (0, 1)):
                log = []
                for c in "ba":
                    p = np.full(len(batch), 1 / 256)
                    for order in range(ORDERS):
                        pair, context = (sum(has[f"{x}{order}_{c}{f}"] for f in folds) for x in "pc")
                        p = (pair + SMOOTHING * p) / (context + SMOOTHING)
                    log.append(np.log(p))
                found.append(pa.array(log[1] - log[0]))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), *found], names=["gram", *SCORES])

    return out.drop(*SUMS).mapInArrow(score, "gram bigint, " + ", ".join(f"{c} double" for c in SCORES))


def text_scores(texts: DataFrame) -> DataFrame:
    """(host, path, label, fold, n, held_out, score) for texts (host, path, text, label, fold, n), one row a text."""
    blocks = max(1, -(-texts.count() // BLOCK))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("block",)):
            found = np.unique(grams(rows["text"].combine_chunks())[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rows["block"][0].as_py(), dtype=np.int32)), pa.array(found)], names=["block", "gram"])

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("gram")
        row, gram = grams(rows["text"].combine_chunks())
        at = np.searchsorted(known["gram"].to_numpy(), gram)
        size = np.bincount(row, minlength=len(rows))
        s0, s1, s = (np.bincount(row, weights=known[c].to_numpy()[at], minlength=len(rows)) / size for c in SCORES)
        held = np.where(rows["fold"].to_numpy() == 0, s0, s1)
        return rows.select(["host", "path", "label", "fold", "n"]).append_column("held_out", pa.array(held)).append_column("score", pa.array(s))

    wanted = dealt.select("block", "text").repartition("block").sortWithinPartitions("block").mapInArrow(needs, "block int, gram bigint")
    known = wanted.join(gram_scores(texts), "gram").select("block", "gram", *SCORES)
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(add, "host string, path string, label int, fold int, n bigint, held_out double, score double")


def _text(host: str, path: str) -> Column:
    return F.concat(F.col(host), F.col(path))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score is null where a rule decides.

    Without labelled rows of both verdicts, or with neither host nor path, the model says allow.
    Ties with the threshold are allowed. The driver gets three counts and a histogram of BINS bins a verdict.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, say = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), say.alias("said"))
    once = rows.groupBy("host", "path").agg(F.first("said").alias("said"), F.count("*").alias("n"))
    texts = cut(
        once.select(
            "host", "path", _text("host", "path").alias("text"), (F.col("said") == "allow").cast("int").alias("label"), F.pmod(F.xxhash64("host", "path"), F.lit(2)).cast("int").alias("fold"), "n"
        )
    )
    if texts.where("label is not null").select("label").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = cut(text_scores(texts))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bin_of(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int32)), batch.column(2)], names=["label", "bin", "n"])

    held = scored.where("label is not null").select("label", "held_out", "n").mapInArrow(bins, "label int, bin int, n bigint")
    limit = threshold({(r["label"], r["bin"]): r["n"] for r in held.groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()})
    model = scored.where("label is null").select(F.col("host").alias("h"), F.col("path").alias("p"), "score")
    judged = rows.where("said is null").join(model, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    blank = _text("host", "path") == ""
    verdict = F.when(blank | (F.col("score") >= limit), "allow").otherwise("block")
    ruled = rows.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip((score + SPAN) * BINS / (2 * SPAN), 0, BINS - 1).astype(np.int64)


def threshold(counts: dict[tuple[int, int], int]) -> float:
    """The lower edge of the bin from which on allowing gives the best balanced accuracy; the middle one of ties."""
    n = [[counts.get((c, b), 0) for b in range(BINS)] for c in (0, 1)]
    total = [max(sum(x), 1) for x in n]
    kept, blocked, best = sum(n[1]), 0, []
    for b in range(BINS):
        best.append(kept / total[1] + blocked / total[0])
        kept, blocked = kept - n[1][b], blocked + n[0][b]
    top = [b for b, x in enumerate(best) if x == max(best)]
    return top[len(top) // 2] * 2 * SPAN / BINS - SPAN
