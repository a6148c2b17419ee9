"""Rules between a claim and its evidence. Each gives true, false or null (nothing to check)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import patterns as p
from veritide.functions import text as t
from veritide.operators.citations import strip_markers

FINDINGS = (
    "claim strengthens association into causation",
    "claim removes modal uncertainty present in evidence",
    "claim adds exclusivity, primacy, or unsupported generalization",
)

#: Fields of forms_of(), in the order of what it folds, and the rows that it turns into Python objects at a time.
FOLDED = ("quotes", "sentences", "own", "there", "one")
SLICE = 256


def with_forms(pairs: DataFrame, claim: str = "claim", evidence: str = "evidence", mode: str = "compat") -> DataFrame:
    """pairs with __f (the parts of claim and evidence that the rules read, folded in one Arrow step), __best and __window."""
    c, e = F.coalesce(claim, F.lit("")), F.coalesce(evidence, F.lit(""))
    quotes = t.quotes(strip_markers(c, mode))
    named = c.rlike(p.ATTRIBUTION_HINT)  # the pattern itself tries a name at every place
    group = lambda i: F.when(named, F.nullif(F.regexp_extract(c, p.ATTRIBUTION, i), F.lit("")))
    rows = pairs.withColumns({"__q": quotes, "__s": t.sentences(e), "__cv": t.value_tokens(c), "__ev": t.value_tokens(e)})
    rows = rows.withColumn("__one", F.array(strip_markers(c, mode), e, F.coalesce(group(1), group(2), group(3))))
    rows = rows.withColumn("__x", forms_of(*[F.col(n) for n in ("__q", "__s", "__cv", "__ev", "__one")]))
    ascii_marks = lambda xs: F.transform(xs, lambda x: F.translate(x, "٬٫", ",."))
    forms = F.struct(
        c.alias("claim"), e.alias("evidence"), F.col("__q").alias("quotes"), F.col("__x.quotes").alias("quotes_folded"), F.col("__s").alias("sentences"), F.col("__x.sentences").alias("sentences_folded"),
        ascii_marks(F.col("__x.own")).alias("claim_values"), ascii_marks(F.col("__x.there")).alias("evidence_values"),
        F.col("__x.one")[0].alias("claim_folded"), F.col("__x.one")[1].alias("evidence_folded"), F.col("__x.one")[2].alias("attributed"),
    )
    rows = rows.withColumn("__f", forms).withColumn("__best", F.col("__x.best")).drop("__q", "__s", "__cv", "__ev", "__one", "__x")
    return rows.withColumn("__window", _window(F.col("__f"), F.col("__best")))


def _long_words(folded: str) -> set[str]:
    return {w for w in folded.split(" ") if len(w) > 2}


def _form(quotes: list[str], sentences: list[str], own: list[str], there: list[str], one: list[str | None]) -> dict:
    """The folded parts, and of the sentences the first that shares most long words with the claim (the first of one), two at least."""
    folded = [[None if x is None else t.fold(x) for x in xs] for xs in (quotes, sentences, own, there, one)]
    words = _long_words(folded[4][0])
    overlap, at = max(((len(words & _long_words(x)), -i) for i, x in enumerate(folded[1])), default=(0, 0))
    best = {"overlap": overlap, "sentence": sentences[-at]} if overlap > 1 else {"overlap": None, "sentence": None}
    return dict(zip(FOLDED, folded, strict=True)) | {"best": best}


def forms_of(*parts: Column) -> Column:
    """_form() of every row, as a struct; best is struct(overlap, sentence).

    One Arrow step: nested higher-order functions would be interpreted for every word, and again in every filter. Only
    SLICE rows at a time become Python objects, so a worker holds little more than its Arrow batch.
    """
    strings = pa.list_(pa.string())
    kind = pa.struct([*((n, strings) for n in FOLDED), ("best", pa.struct([("overlap", pa.int32()), ("sentence", pa.string())]))])

    def run(*columns: pa.Array) -> pa.Array:
        done = [pa.array([], kind)]
        for at in range(0, len(columns[0]), SLICE):
            done.append(pa.array([_form(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], kind))
        return pa.concat_arrays(done)

    named = ", ".join(f"{n}: array<string>" for n in FOLDED)
    # so called, it is not run once more for a filter on its result
    return F.arrow_udf(run, f"struct<{named}, best: struct<overlap: int, sentence: string>>").asNondeterministic()(*parts)


def _window(f: Column, best: Column) -> Column:
    """The sentences with a quoted passage, or else the best matching one; the whole evidence where there is none."""
    holds = F.filter(F.arrays_zip(f["sentences"].alias("s"), f["sentences_folded"].alias("n")), lambda x: F.exists(f["quotes_folded"], lambda q: x["n"].contains(q)))
    quoted = F.when(F.size(holds) > 0, F.array_join(F.transform(holds, lambda x: x["s"]), " ")).otherwise(f["evidence"])
    return F.when(F.size(f["quotes"]) > 0, quoted).otherwise(F.coalesce(best["sentence"], f["evidence"]))


def quote_check(f: Column) -> Column:
    """Null without quotations; do all occur, exactly or folded?"""
    both = F.arrays_zip(f["quotes"].alias("q"), f["quotes_folded"].alias("n"))
    return F.when(F.size(f["quotes"]) > 0, F.forall(both, lambda x: f["evidence"].contains(x["q"]) | f["evidence_folded"].contains(x["n"])))


def missing_values(f: Column) -> Column:
    """Values of the claim that the evidence lacks, sorted."""
    return F.array_sort(F.array_except(f["claim_values"], f["evidence_values"]))


def numeric_check(f: Column) -> Column:
    """Null without values; are the claim's values all in the evidence?"""
    return F.when(F.size(f["claim_values"]) > 0, F.size(missing_values(f)) == 0)


def negation_check(f: Column, window: Column) -> Column:
    """False where only one of claim and window negates; else null."""
    return F.when(f["claim"].rlike(p.NEGATION) != window.rlike(p.NEGATION), F.lit(False))


def strengthening(f: Column, window: Column) -> Column:
    """The findings, in order."""
    c = f["claim"]
    causal = c.rlike(p.CAUSAL) & window.rlike(p.ASSOCIATION) & ~window.rlike(p.CAUSAL)
    modal = ~c.rlike(p.MODAL) & window.rlike(p.MODAL)
    exclusive = c.rlike(p.EXCLUSIVE) & ~window.rlike(p.EXCLUSIVE)
    return F.array_compact(F.array(*[F.when(on, F.lit(say)) for on, say in zip((causal, modal, exclusive), FINDINGS, strict=True)]))


def attribution_check(attributed: Column, authors_folded: Column) -> Column:
    """Null without an attribution or authors; else whether it names one of them."""
    known = F.array_join(authors_folded, " ")
    part = F.exists(F.filter(F.split(attributed, " "), lambda w: F.length(w) > 2), lambda w: known.contains(w))
    return F.when(attributed.isNotNull() & (F.size(authors_folded) > 0), known.contains(attributed) | part)


def check_pairs(pairs: DataFrame, mode: str = "compat") -> DataFrame:
    """pairs (claim, evidence, authors) with quote_ok, numeric_ok, missing, negation_ok, findings, attribution_ok and window."""
    rows = with_forms(pairs, mode=mode)
    f, w = F.col("__f"), F.col("__window")
    if "authors" in pairs.columns:
        rows = rows.withColumn("__authors", t.fold_all(F.coalesce("authors", F.array().cast("array<string>"))))
        attribution = attribution_check(f["attributed"], F.col("__authors"))
    else:
        attribution = F.lit(None).cast("boolean")
    out = rows.withColumns(
        {
            "quote_ok": quote_check(f), "numeric_ok": numeric_check(f), "missing": missing_values(f), "negation_ok": negation_check(f, w),
            "findings": strengthening(f, w), "attribution_ok": attribution, "window": w,
        }
    )
    return out.drop("__f", "__best", "__window", "__authors")
