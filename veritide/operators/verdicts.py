"""From claims and their references to verdicts, report flags and revision plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import text as t
from veritide.functions.scoring import EntailmentScorer, entailment_of, probabilities
from veritide.operators import checks
from veritide.operators.citations import first_of_each, strip_markers
from veritide.operators.claims import claim_type

VALUES = "all numeric/date/statistical values match"
QUOTED = "all quoted wording occurs exactly or after conservative normalization"
MISQUOTED = "quoted wording does not occur in cited evidence"
NEGATED = "claim and evidence differ in explicit negation"
ATTRIBUTED, MISATTRIBUTED = "attribution agrees with available author metadata", "attribution does not agree with available author metadata"
UNRESOLVED, NO_MODEL = "literature claim has no resolvable citation", "semantic NLI adapter was not provided"


def with_references(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims (draft_id, claim_pos, text, claim_type, citation_ids) with plain, refs and combined evidence.

    One join for all citations of all drafts; refs keep the order of the ids, unknown ids drop out.
    """
    plain = claims.withColumn("plain", t.trim(strip_markers(F.col("text"))))
    cited = plain.select("draft_id", "claim_pos", F.posexplode("citation_ids").alias("pos", "citation_id"))
    known = first_of_each(chunks, cited.select(F.col("citation_id").alias("__id")).distinct())
    found = cited.join(known.select(F.col("__id").alias("citation_id"), F.col("ref.text").alias("evidence"), F.col("ref.authors").alias("authors")), "citation_id")
    refs = found.groupBy("draft_id", "claim_pos").agg(F.sort_array(F.collect_list(F.struct("pos", "citation_id", "evidence", "authors"))).alias("refs"))
    rows = plain.join(refs, ["draft_id", "claim_pos"], "left")
    return rows.withColumn("combined", F.array_join(F.transform("refs", lambda r: r["evidence"]), "\n"))


def _attributions(rows: DataFrame) -> DataFrame:
    """rows with __attr: for each reference whether the claim's attribution agrees."""
    flat = F.flatten(F.transform("refs", lambda r: F.coalesce(r["authors"], F.array().cast("array<string>"))))
    rows = rows.withColumn("__folded", t.fold_all(F.coalesce(flat, F.array().cast("array<string>"))))
    size = lambda r: F.size(F.coalesce(r["authors"], F.array().cast("array<string>")))
    start = lambda i: F.aggregate(F.slice("refs", F.lit(1), i), F.lit(0), lambda a, r: a + size(r)) + 1
    own = lambda r, i: F.slice("__folded", start(i), size(r))
    attr = F.transform("refs", lambda r, i: checks.attribution_check(F.col("__f.attributed"), own(r, i)))
    return rows.withColumn("__attr", attr).drop("__folded")


def rule_verdicts(rows: DataFrame, authors: bool = True) -> DataFrame:
    """with_references() rows with verdict, confidence and reasons by the rules alone; verdict is null where a model must decide.

    findings and passed (the reasons gathered so far) stay for the model's step. authors=False says that no reference has
    authors, which saves the step that folds them.
    """
    rows = checks.with_forms(rows.withColumn("__claim", F.col("plain")), "__claim", "combined").drop("__claim")
    rows = _attributions(rows) if authors else rows.withColumn("__attr", F.transform("refs", lambda r: F.lit(None).cast("boolean")))
    f, w = F.col("__f"), F.col("__window")
    quote, numeric, negation = checks.quote_check(f), checks.numeric_check(f), checks.negation_check(f, w)
    lacking = F.concat(F.lit("evidence lacks exact values: "), F.array_join(checks.missing_values(f), ", "))
    no_reference = (F.size("citation_ids") == 0) | F.coalesce(F.size("refs"), F.lit(0)).isin(0, -1)
    misattributed = F.coalesce(F.exists("__attr", lambda x: x.isNotNull() & ~x), F.lit(False))
    agreed = F.transform(F.filter("__attr", lambda x: F.coalesce(x, F.lit(False))), lambda x: F.lit(ATTRIBUTED))
    rows = rows.withColumns(
        {
            "findings": checks.strengthening(f, w),
            "passed": F.concat(F.array_compact(F.array(F.when(quote, F.lit(QUOTED)), F.when(numeric, F.lit(VALUES)))), F.coalesce(agreed, F.array().cast("array<string>"))),
        }
    )
    not_literature = F.col("claim_type") != "LITERATURE_CLAIM"
    say = lambda verdict, confidence, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), F.array(reason).alias("reasons"))
    by_rule = (
        F.when(not_literature, say("UNVERIFIABLE", "LOW", F.concat("claim_type", F.lit(" is not automatically treated as a cited literature claim"))))
        .when(no_reference, say("UNVERIFIABLE", "LOW", F.lit(UNRESOLVED)))
        .when(~quote, say("QUOTE_MISMATCH", "HIGH", F.lit(MISQUOTED)))
        .when(~numeric, say("CONTRADICTED", "HIGH", lacking))
        .when(~negation, say("CONTRADICTED", "HIGH", F.lit(NEGATED)))
        .when(misattributed, say("CONTRADICTED", "HIGH", F.lit(MISATTRIBUTED)))
    )
    return rows.withColumn("__v", by_rule).select("*", "__v.verdict", "__v.confidence", "__v.reasons").drop("__v", "__f", "__window", "__attr")


def without_model(decided: DataFrame) -> DataFrame:
    """Verdicts for what the rules leave open when there is no entailment model."""
    found = F.size("findings") > 0
    open_ = F.col("verdict").isNull()
    reasons = F.concat("passed", F.when(found, F.col("findings")).otherwise(F.array(F.lit(NO_MODEL))))
    return decided.withColumns(
        {
            "reasons": F.when(open_, reasons).otherwise(F.col("reasons")),
            "confidence": F.when(open_, F.when(found, "MEDIUM").otherwise("LOW")).otherwise(F.col("confidence")),
            "verdict": F.when(open_, F.when(found, "PARTIALLY_SUPPORTED").otherwise("UNVERIFIABLE")).otherwise(F.col("verdict")),
        }
    )


def pair_verdicts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, claim_type, verdict, confidence, reasons) of pairs (keys, claim, evidence), each claim judged by the rules against the evidence beside it.

    A claim with evidence counts as cited; one without is judged by its class alone. Null claims count as empty.
    """
    plain = t.trim(strip_markers(F.coalesce("claim", F.lit(""))))
    cited = F.when(F.col("evidence").isNotNull(), F.array(F.lit("evidence"))).otherwise(F.array().cast("array<string>"))
    ref = F.struct(F.lit(0).alias("pos"), F.lit("evidence").alias("citation_id"), F.col("evidence"), F.array().cast("array<string>").alias("authors"))
    rows = pairs.select(*keys, "evidence", plain.alias("plain"), cited.alias("citation_ids"))
    rows = rows.withColumns({"claim_type": claim_type(F.col("plain"), F.col("citation_ids")), "refs": F.when(F.size("citation_ids") > 0, F.array(ref)), "combined": F.col("evidence")})
    return without_model(rule_verdicts(rows, authors=False)).select(*keys, "claim_type", "verdict", "confidence", "reasons")


def premises(evidence: Column) -> Column:
    """The sentences of more than 8 characters; the whole evidence if there is at most one."""
    long = F.filter(t.sentences(evidence), lambda s: F.length(s) > 8)
    return F.when(F.size(long) > 1, long).otherwise(F.array(evidence))


def best_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of scores (keys, pos, entailment, neutral, contradiction) the strongest of each claim: the top contradiction where it reaches the top entailment, else the latter. First places win ties."""
    whole = F.struct("entailment", "neutral", "contradiction", "pos")
    top = scored.groupBy(keys).agg(
        F.max_by(whole, F.struct("entailment", -F.col("pos"))).alias("e"),
        F.max_by(whole, F.struct("contradiction", -F.col("pos"))).alias("c"),
    )
    return top.select(*keys, F.when(F.col("c.contradiction") >= F.col("e.entailment"), F.col("c")).otherwise(F.col("e")).alias("nli"))


def with_model(decided: DataFrame, scorer: EntailmentScorer, entailment: float = 0.7, contradiction: float = 0.7) -> DataFrame:
    """Verdicts for what the rules leave open, by an entailment model that scores sentence by sentence.

    Only open claims reach the model: rows are filtered before it and joined back, since a UDF inside a
    conditional would run on every row.
    """
    keys = ["draft_id", "claim_pos"]
    open_ = decided.where("verdict is null")
    pairs = open_.select(*keys, t.without_frame(F.col("plain")).alias("hypothesis"), F.posexplode(premises(F.col("combined"))).alias("pos", "premise"))
    scored = pairs.withColumn("raw", entailment_of(F.col("premise"), F.col("hypothesis"), scorer)).withColumn("p", probabilities(F.col("raw")))
    scored = scored.select(*keys, "pos", F.col("p")[0].alias("entailment"), F.col("p")[1].alias("neutral"), F.col("p")[2].alias("contradiction"))
    rows = decided.join(best_scores(scored, keys), keys, "left")
    e, c, found, undecided = F.col("nli.entailment"), F.col("nli.contradiction"), F.size("findings") > 0, F.col("verdict").isNull()
    verdict = F.when(c >= contradiction, "CONTRADICTED").when((e >= entailment) & ~found, "SUPPORTED").when((e >= entailment) | found, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    reason = (
        F.when(c >= contradiction, F.array(F.lit("local NLI estimates contradiction")))
        .when((e >= entailment) & ~found, F.array(F.lit("local NLI estimates entailment")))
        .when(found, F.col("findings"))
        .otherwise(F.array(F.lit("local NLI does not estimate entailment")))
    )
    return rows.withColumns(
        {
            "reasons": F.when(undecided, F.concat("passed", reason)).otherwise(F.col("reasons")),
            "confidence": F.when(undecided, F.when(verdict.isin("CONTRADICTED", "SUPPORTED"), "HIGH").otherwise("MEDIUM")).otherwise(F.col("confidence")),
            "verdict": F.when(undecided, verdict).otherwise(F.col("verdict")),
        }
    )


def report_failed(verdicts: DataFrame, structural: DataFrame, strict: Column | bool = False) -> DataFrame:
    """(draft_id, failed): an invalid marker, a contradiction or misquotation, or, if strict, a literature claim short of support."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    hard = F.col("verdict").isin("CONTRADICTED", "QUOTE_MISMATCH")
    soft = strict & (F.col("claim_type") == "LITERATURE_CLAIM") & F.col("verdict").isin("PARTIALLY_SUPPORTED", "UNSUPPORTED", "UNVERIFIABLE")
    claims = verdicts.select("draft_id", (hard | soft).alias("bad"))
    return claims.unionByName(structural.select("draft_id", (~F.col("valid")).alias("bad"))).groupBy("draft_id").agg(F.bool_or("bad").alias("failed"))


def histogram(verdicts: DataFrame) -> DataFrame:
    """(verdict, n) by verdict."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n")).orderBy("verdict")


def revision_items(verdicts: DataFrame) -> DataFrame:
    """Claims short of support with the action to take and the reasons in one line; alternatives is an optional array column."""
    has_other = F.coalesce(F.size("alternatives") > 0, F.lit(False)) if "alternatives" in verdicts.columns else F.lit(False)
    action = F.when(F.col("verdict") == "QUOTE_MISMATCH", "REWRITE").when(F.col("verdict") == "CONTRADICTED", "REMOVE").when(has_other, "INSPECT_ALTERNATIVE_EVIDENCE").otherwise("QUALIFY")
    return verdicts.where("verdict <> 'SUPPORTED'").withColumns({"action": action, "reason": F.array_join("reasons", "; ")})


def evaluation(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pairs (expected, predicted): the confusion counts, and precision, recall and F1 of every class with the macro F1."""
    confusion = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    hits = confusion.select(F.explode(F.array(
        F.struct(F.col("expected").alias("label"), F.col("n").alias("actual"), F.lit(0).alias("said"), F.lit(0).alias("both")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("actual"), F.col("n").alias("said"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("both")),
    )).alias("x")).select("x.*")
    by_class = hits.groupBy("label").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("both").alias("both"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = by_class.select("label", share(F.col("both"), F.col("said")).alias("precision"), share(F.col("both"), F.col("actual")).alias("recall"), share(2 * F.col("both"), F.col("said") + F.col("actual")).alias("f1"))
    macro = scored.agg(F.lit("macro").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return confusion, scored.withColumn("label", F.col("label").cast("string")).unionByName(macro)
