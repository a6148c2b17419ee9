"""Verification of drafts: structure, claims, verdicts, report and revision plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.config import EngineConfig
from veritide.functions.scoring import Embedder, EntailmentScorer, PairScorer
from veritide.operators import verdicts
from veritide.operators.citations import bibliography, parse_markers, validate_markers
from veritide.operators.claims import extract_claims
from veritide.plans.search import alternatives


@dataclass
class Report:
    """The frames of one verification: a row per marker, per claim and per draft."""

    structural: DataFrame
    claims: DataFrame
    drafts: DataFrame

    def plan(self) -> DataFrame:
        return verdicts.revision_items(self.claims)


def markers_of(drafts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(draft_id, pos, marker) of drafts (draft_id, text)."""
    return drafts.select("draft_id", F.posexplode(parse_markers(F.col("text"), config.marker_mode)).alias("pos", "marker"))


def verify(
    drafts: DataFrame, chunks: DataFrame, listing: DataFrame, scorer: EntailmentScorer | None = None, retriever: tuple[Embedder, PairScorer] | None = None, strict: bool = False, config: EngineConfig = EngineConfig()
) -> Report:
    """Checks drafts (draft_id, text) against stored chunks and live sources; without scorer the rules alone decide.

    Every draft has a row in drafts, with failed. retriever adds alternatives to literature claims short of support.
    """
    structural = validate_markers(markers_of(drafts, config), chunks, listing)
    decided = verdicts.rule_verdicts(verdicts.with_references(extract_claims(drafts, config.marker_mode), chunks))
    if scorer is None:
        claims = verdicts.without_model(decided)
    else:
        claims = verdicts.with_model(decided, scorer, config.entailment_threshold, config.contradiction_threshold)
    if retriever is not None:
        short = claims.where("verdict <> 'SUPPORTED' and claim_type = 'LITERATURE_CLAIM'")
        claims = claims.join(alternatives(short, chunks, *retriever, config), ["draft_id", "claim_pos"], "left")
    flags = verdicts.report_failed(claims, structural, strict)
    return Report(structural, claims, drafts.select("draft_id").join(flags, "draft_id", "left").select("draft_id", F.coalesce("failed", F.lit(False)).alias("failed")))


def cited_works(drafts: DataFrame, chunks: DataFrame, listing: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """The bibliography of all passages that drafts cite, and the marker results."""
    results = validate_markers(markers_of(drafts, config), chunks, listing)
    found = results.where("ref is not null").select("pos", "ref.*")
    return bibliography(found), results
