"""Quality rules by document and by host, in DataFrame functions only.

Documents that fail a base rule go. Softer rules (symbols, word length, repeated lines) say little
about one document, so they count by host: the failures of each rule are summed by domain, the rate
is shrunk by a beta prior fitted to all hosts (method of moments, sampling noise taken off), and a
host is flagged for a rule when its posterior mean less two standard deviations exceeds both RATE
and twice the prior mean. A document is rejected when its host is flagged for a rule that the
document itself fails; clean documents of a bad host stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.llm.cluster import cut, spread_join

MIN_WORDS, REPEAT_PERCENT, RATE = 50, 50, 0.2
SOFT = ("symbols", "word_length", "dup_lines")
BROADCAST_HOSTS = 50_000
BLANKS = "[ \\t-\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeated(w: Column, n: Column) -> Column:
    """Words of w that lie in a three-word window found twice or more."""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.array_compact(
            F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]))
        )
        at = let(placed, twice)
        words = F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(words)

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column) -> Column:
    """A struct of the counts of one text (null: empty), each computed over the whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    long = lambda c, name: c.cast("bigint").alias(name)
    by_words = let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(_repeated(w, F.size(w)), "n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    return F.struct(by_words.alias("w"), by_lines.alias("x"), long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"))


def flags(m: str) -> dict[str, Column]:
    """Rule failures of a measures() column."""
    w, x = F.col(f"{m}.w"), F.col(f"{m}.x")
    return {
        "base_failed": (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"]),
        "symbols": 10 * F.col(f"{m}.n_symbols") > w["n_words"],
        "word_length": (w["word_chars"] < 3 * w["n_words"]) | (w["word_chars"] > 10 * w["n_words"]),
        "dup_lines": 10 * x["n_dup_lines"] > 3 * x["n_lines"],
    }


def host_of(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host (null: empty) and the measures and rule failures of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), host_of(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    return base.select("doc_id", "host", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.x.n_dup_lines", "m.w.n_repeat_words", "m.x.n_lines", *[c.alias(n) for n, c in flags("m").items()])


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Per host with a flag: host, and for each soft rule bad_<rule>, from the shrunk failure rates."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(r) for r in SOFT])
    hosts = cut(hosts)
    rate = lambda r: F.col(r) / F.col("n")
    moments = hosts.agg(F.avg(1 / F.col("n")).alias("inv"), *[f(rate(r)).alias(f"{k}_{r}") for r in SOFT for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    bad = {}
    for r in SOFT:
        mean, var = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        noise = mean * (1 - mean) * (moments["inv"] or 0.0)
        strength = min(max(mean * (1 - mean) / max(var - noise, 1e-9) - 1, 1.0), 1e6)
        a, b = max(mean, 1e-6) * strength, max(1 - mean, 1e-6) * strength
        post = (F.col(r) + a) / (F.col("n") + a + b)
        low = post - 2 * F.sqrt(post * (1 - post) / (F.col("n") + a + b + 1))
        bad[f"bad_{r}"] = low > max(RATE, 2 * mean)
    return hosts.withColumns(bad).select("host", *bad).where(" or ".join(bad))


def _rejected(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows (host, rule failures, ..., as a checkpoint or a scan) with host_rejected. bad is a checkpoint; host flags are broadcast while few, else joined with hot hosts split off."""
    joined = rows.join(F.broadcast(bad), "host", "left") if bad.count() <= BROADCAST_HOSTS else spread_join(rows, bad, ["host"], "left")
    fails = F.lit(False)
    for r in SOFT:
        fails = fails | (F.coalesce(F.col(f"bad_{r}"), F.lit(False)) & F.coalesce(F.col(r), F.lit(False)))
    return joined.withColumn("host_rejected", fails)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: its measures, base_failed, kept and host_rejected.

    Null and empty texts have no words and fail; a null host is the empty one; repeated rows count and are judged
    each for itself; rows with a null id are judged like others; an empty table gives none.
    """
    measured = cut(document_measures(docs, id_col, text_col, host_col))
    kept = (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")
    return _rejected(measured, cut(host_verdicts(measured))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "host_rejected")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that quality_verdicts() keeps, with all their columns.

    Texts are measured once for the hosts and once more as the result is read, so that no copy of the corpus is written. Only where
    more than BROADCAST_HOSTS hosts are flagged, rows are checkpointed and joined to them with hot hosts split off. Nulls,
    repeats and empty tables as in quality_verdicts().
    """
    mark = "__veritide_quality"
    measured = docs.withColumn(f"{mark}_m", measures(F.col(text_col)))
    own = F.struct(host_of(host_col).alias("host"), *[c.alias(n) for n, c in flags(f"{mark}_m").items()])
    rows = measured.withColumn(mark, own).select(*[F.col(f"`{c}`") for c in docs.columns], mark)
    bad = cut(host_verdicts(rows.select(f"{mark}.*")))
    if bad.count() > BROADCAST_HOSTS:
        rows = cut(rows)
    rows = rows.where(~F.col(f"{mark}.base_failed"))
    inner = _rejected(rows.select(f"{mark}.*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mark)), bad)
    return inner.where("not host_rejected").select(f"{mark}.*")
