"""Claims: segmentation of drafts into sentences, and their classification."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import patterns as p
from veritide.functions.text import trim
from veritide.operators.citations import cited_ids, strip_markers

# Fixed value: the boundaries between claims, in Python syntax.
BOUNDARY = re.compile(r"(?<=[.!?؟؛。！？])(?:[\"'»”)]*)\s+|\n+")
_SHORT = frozenset(p.ABBREVIATIONS)


def segments(text: str) -> list[tuple[str, int, int, int]]:
    """(claim, start, end, line breaks passed) of a draft; a boundary behind an abbreviation is none."""
    spans, begin, lines = [], 0, 0
    for found in BOUNDARY.finditer(text):
        last = text[begin : found.start()].rstrip().rstrip(".").lower().split()[-2:]
        if last and (last[-1] in _SHORT or " ".join(last) in _SHORT):
            continue
        spans.append((begin, found.start(), lines))
        begin, lines = found.end(), lines + found.group().count("\n")
    spans.append((begin, len(text), lines))
    out = []
    for a, b, n in spans:
        claim = text[a:b].strip()
        if claim:
            start = a + len(text[a:b]) - len(text[a:b].lstrip())
            out.append((claim, start, start + len(claim), n))
    return out


def _segments(text: Column | str) -> Column:
    names = ("text", "start", "end", "paragraph")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [dict(zip(names, s, strict=True)) for s in segments(x or "")])

    return F.pandas_udf(run, "array<struct<text:string,start:int,end:int,paragraph:int>>")(text)


def words(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(text, f"{p.SPACE}+"), lambda w: w != ""))


def claim_type(text: Column, ids: Column, mode: str = "compat") -> Column:
    """The class of a claim, judged on its text without markers; the first rule that holds decides."""
    plain = trim(strip_markers(text, mode))
    n = words(plain)
    return (
        F.when(plain == "", "TRANSITION")
        .when(plain.rlike(p.TRANSITION) & (n < 12), "TRANSITION")
        .when(plain.rlike(p.PROCEDURAL), "PROCEDURAL")
        .when((F.size(ids) > 0) | plain.rlike(p.LITERATURE) | plain.rlike(p.FACT_SIGNAL), "LITERATURE_CLAIM")
        .when(plain.rlike(p.OPINION), "OPINION")
        .when(plain.rlike(p.INFERENCE), "INFERENCE")
        .when(n >= 4, "GENERAL_FACT")
        .otherwise("UNCERTAIN")
    )


def extract_claims(drafts: DataFrame, mode: str = "compat") -> DataFrame:
    """(draft_id, claim_pos, text, start, end, paragraph, claim_type, citation_ids) of drafts (draft_id, text); offsets in code points."""
    rows = drafts.select("draft_id", F.posexplode(_segments("text")).alias("claim_pos", "c")).select("draft_id", "claim_pos", "c.*")
    rows = rows.withColumn("citation_ids", cited_ids(F.col("text"), mode))
    return rows.withColumn("claim_type", claim_type(F.col("text"), F.col("citation_ids"), mode))
