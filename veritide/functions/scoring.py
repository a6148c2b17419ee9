"""Scorer interfaces and deterministic stand-ins for the embedding, reranking and entailment models."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veritide.functions.text import fold


class Embedder(Protocol):
    """Unit vectors for texts. A models.Lazy stands for one that each Python worker loads once."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """One score a (query, passage) pair."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class EntailmentScorer(Protocol):
    """(entailment, neutral, contradiction) for each (premise, hypothesis) pair."""

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]: ...


@lru_cache(maxsize=1 << 17)
def _hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")


class HashEmbedder:
    """Hashed character trigrams, normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            folded = f"  {fold(text)}  "
            for gram, n in Counter(folded[j : j + 3] for j in range(len(folded) - 2)).items():
                h = _hash(gram)
                out[i, h % self.dimension] += n if h >> 63 else -n
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class OverlapReranker:
    """Share of the query's words that the passage has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            q, w = set(fold(query).split()), set(fold(passage).split())
            out.append(len(q & w) / len(q) if q else 0.0)
        return out


class OverlapEntailment:
    """Entailment by shared words; no contradiction is ever seen."""

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        out = []
        for premise, hypothesis in pairs:
            h, w = set(fold(hypothesis).split()), set(fold(premise).split())
            share = len(h & w) / len(h) if h else 0.0
            out.append((share, 1 - share, 0.0))
        return out


def embedding_of(text: Column, embedder: Embedder, batch_size: int | None = None) -> Column:
    """Vectors of a text column, the model getting batch_size texts at a time (an Arrow batch, if None); null texts embed as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            plain = [t or "" for t in texts]
            size = batch_size or len(plain) or 1
            yield pd.Series([v for at in range(0, len(plain), size) for v in embedder.embed(plain[at : at + size])])

    return F.pandas_udf(run, "array<double>")(text)


def pair_score(query: Column, passage: Column, scorer: PairScorer) -> Column:
    """Scores of pairs, in Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in batches:
            found = list(scorer.score(list(zip(queries.fillna(""), passages.fillna(""), strict=True))))
            if len(found) != len(queries):
                raise RuntimeError("the reranker gave another number of scores than there are pairs")
            yield pd.Series(found, dtype=float)

    return F.pandas_udf(run, "double")(query, passage)


def entailment_of(premise: Column, hypothesis: Column, scorer: EntailmentScorer) -> Column:
    """array<double> of the three scores, in Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for premises, hypotheses in batches:
            yield pd.Series([list(map(float, x)) for x in scorer.score(list(zip(premises.fillna(""), hypotheses.fillna(""), strict=True)))])

    return F.pandas_udf(run, "array<double>")(premise, hypothesis)


def probabilities(values: Column) -> Column:
    """Three raw scores as probabilities: softmax unless they already are, then they are rescaled. Null unless three finite scores."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    raw = F.exists(values, lambda x: x < 0) | (total <= 0) | (F.abs(total - 1) > 1e-4)
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    soft = F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when((F.size(values) == 3) & finite, F.when(raw, soft).otherwise(F.transform(values, lambda x: x / total)))
