"""review_answers: judges every turn of recorded conversations against the turn it answers.

    python -m jobs.review_answers --conversations DIR --output DIR [--config jobs/review_answers.json]

The turn before is the evidence. Rules check quotations, numbers, negation and strengthened wording; what no rule decides
stays unverifiable, since no model is bundled. The job reads Parquet (conv_id, turn, role, text) and writes

    output/verdicts  Parquet by verdict: one row a turn, with claim_type, confidence and reason
    output/summary   JSON lines: turns and distinct conversations by role and verdict

Both are overwritten as a whole, so a run after a crash, or a second run, leaves the same rows. Roles that no one
reviews can be left out by the setting roles.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from veritide.operators.verdicts import pair_verdicts
from veritide.plans.catalogue import answers_with_evidence
from veritide.shipping import ship

log = logging.getLogger("jobs.review_answers")

VERDICTS = "conv_id bigint, turn bigint, role string, claim_type string, confidence string, reason string, verdict string"


@dataclass(frozen=True)
class Config:
    """roles: whose turns to judge, none for all. Turns of every role are evidence."""

    roles: tuple[str, ...] | list[str] = ()


def judged(turns: DataFrame, config: Config = Config()) -> DataFrame:
    """The verdict of each turn that is to be reviewed. The join is on conversation and turn, so a long conversation spreads over tasks."""
    pairs = answers_with_evidence(turns)
    if config.roles:
        pairs = pairs.where(F.col("role").isin(*config.roles))
    rows = pair_verdicts(pairs, ["conv_id", "turn", "role"])
    return rows.select("conv_id", "turn", "role", "claim_type", "confidence", F.array_join("reasons", "; ").alias("reason"), "verdict")


def run(spark: SparkSession, conversations: str, output: str, config: Config = Config()) -> None:
    """Writes the verdicts and their summary, and logs what was read and written."""
    turns = ship(spark).read.parquet(conversations).select("conv_id", "turn", "role", "text")
    judged(turns, config).hint("rebalance", "verdict").write.mode("overwrite").partitionBy("verdict").parquet(f"{output}/verdicts")
    written = verdicts(spark, output)
    counts = written.groupBy("role", "verdict").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))
    counts.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    log.info("read %d turns from %s, wrote %d verdicts to %s", turns.count(), conversations, written.count(), output)


def verdicts(spark: SparkSession, output: str) -> DataFrame:
    """What the last run wrote."""
    return spark.read.schema(VERDICTS).parquet(f"{output}/verdicts")


if __name__ == "__main__":
    command("review_answers: turns against the turns they answer", ["conversations", "output"], Config, run)
