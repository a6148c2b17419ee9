"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels alone.

A document is a bag of sentences; a sentence is toxic with probability sigmoid(bias + sum of the weights of
its features), and a document is toxic unless all of its sentences are not: 1 - product(1 - p). Features are
the words of a sentence, lower-cased, and their beginnings of 3 to LONGEST bytes, hashed into 2**BITS places; long
sentences are judged in pieces of PIECE words, whose scores meet by the same noisy-or. Since no sentence
has a label, the gradient of the document's likelihood says which sentences the label speaks of; the same
sentence scores then locate the offending sentences.

Only the fit uses a sample: SAMPLE labelled documents, those of the least hashes of their ids, and of their texts
CHARS characters in that order. One task fits the model on them; every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.llm.words import mix

BITS, LEAST, LONGEST, PIECE = 20, 3, 12, 40
#: Labelled documents that the model is fitted on, and the characters of their texts, at most.
SAMPLE, CHARS = 8192, 64_000_000
#: A feature takes part if it occurs in MIN_DOCS documents and its share differs between labels by Z standard errors.
MIN_DOCS, Z = 5, 3.5
STEPS, RATE, DECAY = 300, 0.1, 0.02
#: Shares of wrong labels that the fit allows for: clean documents marked toxic, and toxic ones marked clean.
LEAK, MISS = 0.005, 0.01
#: A document of this score or more is toxic; a sentence of such a document offends from OFFENDS on, and its highest always does.
THRESHOLD, OFFENDS = 0.3, 0.2

SENTENCE = r"[^.!?؟。\n]+[.!?؟。\n]*|[.!?؟。\n]+"
SCORED = "doc_id {0}, score double, offending array<struct<start:int,end:int,score:double,text:string>>"
MODEL = "place int, weight double"
BIAS = -1  # the place of the bias among the model's rows

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Is crc32(doc_id as text) mod 4 equal to 2? Such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sentences_of(text: Column) -> Column:
    """The text cut behind stops and line ends, nothing left out; null and empty texts have no sentence."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 0)


def _words(sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, sentence) of the words: letters and digits, and all beyond ASCII but Latin-1 signs and general punctuation."""
    sentences = sentences.cast(pa.large_string()).fill_null("")
    _, offsets, raw = sentences.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[sentences.offset : sentences.offset + len(sentences) + 1]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    after = np.append(data[1:], 0)
    for lead, low, high, size in ((0xC2, 0xA0, 0xBF, 2), (0xE2, 0x80, 0x81, 3)):
        signs = np.flatnonzero((data == lead) & (after >= low) & (after <= high)) + 1
        for i in range(size):
            inside[signs + i] = False
    breaks = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    opens[breaks] = inside[1:-1][breaks]
    closes[breaks - 1] = inside[1:-1][breaks - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return _LOWER[data], start, end, np.searchsorted(offsets, start, side="right") - 1


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, place) for the beginnings of each length, and for whole words of LONGEST bytes at most."""
    h = np.zeros(len(start), dtype=np.uint64)
    word, size = np.arange(len(start)), end - start
    for k in range(LONGEST):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[start[word] + k] + np.uint64(1)
        if k + 1 >= LEAST:
            yield word, (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        whole = size[word] == k + 1
        yield word[whole], (mix(~h[whole]) >> np.uint64(64 - BITS)).astype(np.int64)
        longer = size[word] > k + 1
        h, word = h[longer], word[longer]


def _pieces(sentence: np.ndarray) -> np.ndarray:
    """The piece of every word, numbered through all sentences; a sentence's words are in a row."""
    if not len(sentence):
        return sentence
    new = np.append(True, sentence[1:] != sentence[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(sentence)), 0))
    return np.cumsum(new | ((np.arange(len(sentence)) - first) % PIECE == 0)) - 1


class _Bags:
    """The sample as arrays: (document, piece, place) of every feature in each piece, once."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.labels: list[int] = []
        self.pieces: list[np.ndarray] = []  # the document of each piece
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # (piece, place)
        n_pieces = read = 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                if read >= CHARS:
                    return
                lists = part.column("sentences")
                doc = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                data, start, end, sentence = _words(lists.flatten())
                read += len(data)
                piece = _pieces(sentence)
                of = np.zeros(piece[-1] + 1 if len(piece) else 0, dtype=np.int64)
                of[piece] = doc[sentence] + len(self.labels) if len(piece) else 0
                keys = [np.unique((piece[w] << BITS) | place) for w, place in _features(data, start, end)]
                keys = np.concatenate(keys)
                self.rows.append(((keys >> BITS).astype(np.int32) + np.int32(n_pieces), (keys & ((1 << BITS) - 1)).astype(np.int32)))
                self.pieces.append(of)
                self.labels += part.column("toxic").to_pylist()
                n_pieces += len(of)


def _screened(bags: _Bags, of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places whose share of documents differs between the labels."""
    counts = np.zeros((2, 1 << BITS))
    for piece, place in bags.rows:
        pair = np.unique((of[piece].astype(np.int64) << BITS) | place)
        label = y[pair >> BITS]
        for c in (0, 1):
            counts[c] += np.bincount(pair[label == c] & ((1 << BITS) - 1), minlength=1 << BITS)
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    share = counts.sum(axis=0) / (n0 + n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    z = np.abs(counts[1] / n1 - counts[0] / n0) / error
    return np.flatnonzero((counts.sum(axis=0) >= MIN_DOCS) & (z >= Z))


def fit(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) from batches (sentences, toxic) by gradient steps on the likelihood of all documents together."""
    bags = _Bags(batches)
    y = np.array(bags.labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), -np.inf if not len(y) or y.max() == 0 else np.inf
    of = np.concatenate(bags.pieces)
    places = _screened(bags, of, y)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[places] = np.arange(len(places))
    kept = [(piece[column[place] >= 0], column[place[column[place] >= 0]]) for piece, place in bags.rows]
    piece, feature = (np.concatenate(x) for x in zip(*kept, strict=True))
    live, piece = np.unique(piece, return_inverse=True)  # the pieces with a feature that takes part
    doc = of[live]
    idle = np.bincount(of, minlength=len(y)) - np.bincount(doc, minlength=len(y))
    w, b = np.zeros(len(places)), -4.0
    m, v = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(piece, weights=w[feature], minlength=len(live))
        calm = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) + idle * np.logaddexp(0, b)  # -log of "no sentence is toxic"
        none = np.exp(-calm)
        toxic, clean = 1 - (1 - LEAK) * none, (1 - MISS) * none + MISS
        slope = np.where(y == 1, -(1 - LEAK) * none / np.maximum(toxic, 1e-12), (1 - MISS) * none / clean)
        p = 1 / (1 + np.exp(-z))
        pull = slope[doc] * p
        grad = np.append(np.bincount(feature, weights=pull[piece], minlength=len(w)), pull.sum() + (slope * idle).sum() / (1 + np.exp(-b))) / len(y)
        grad[:-1] += DECAY * w / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return places, w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The model as rows (place, weight), the bias at place BIAS, from the labelled rows of docs that are not held out.

    labels (doc_id, toxic): null ids and labels are ignored, of several labels of an id the highest holds. Of docs
    that repeat an id each row is a document.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    some = known.withColumn("__at", spread).orderBy("__at", "doc_id").limit(sample)
    bags = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # the sample has a fixed bound
    ordered = bags.repartition(1).sortWithinPartitions("__at", "doc_id", "text").select(sentences_of(F.col("text")).alias("sentences"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = fit(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, BIAS), pa.int32()), pa.array(np.append(weights, bias))], names=["place", "weight"])

    return ordered.mapInArrow(run, MODEL)


class Scorer:
    """Sentence scores by a fitted model."""

    def __init__(self, model: list[tuple[int, float]]):
        self.bias = dict(model).get(BIAS, -np.inf)
        self.places = np.array([p for p, _ in model if p != BIAS], dtype=np.int64)
        self.weights = np.array([w for p, w in model if p != BIAS])

    def calm(self, sentences: pa.Array) -> np.ndarray:
        """-log(1 - p) of each sentence; 0 without words."""
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.places] = self.weights
        data, start, end, sentence = _words(sentences)
        word = np.zeros(len(start))
        for w, place in _features(data, start, end):
            word[w] += table[place]
        # a feature counts once a piece, as in the fit; only words with weight can repeat one
        piece = _pieces(sentence)
        z = np.bincount(piece, weights=self._once(data, start, end, piece, word, table)) if len(piece) else np.zeros(0)
        of = np.zeros(len(z), dtype=np.int64)
        of[piece] = sentence
        return np.bincount(of, weights=np.logaddexp(0, z + self.bias), minlength=len(sentences)) if len(z) else np.zeros(len(sentences))

    def _once(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, word: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The weight of each word without features that an earlier word of its piece has."""
        hit = np.flatnonzero(word)
        out = word.copy()
        out[hit] = 0
        for w, place in _features(data, start[hit], end[hit]):
            live = table[place] != 0
            w, place = w[live], place[live]
            _, first = np.unique((piece[hit[w]] << BITS) | place, return_index=True)
            np.add.at(out, hit[w[first]], table[place[first]])
        return out


def score_documents(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score, offending) a row of docs: the noisy-or of its sentences, and the sentences that make a document of THRESHOLD or more toxic.

    offending has start and end in code points, end exclusive, score and text, in order. Null, empty and wordless
    texts score 0. Repeated rows and null ids are scored like any; other columns don't matter. An empty table gives
    an empty result; without labelled documents of both kinds every text with words scores 0 (or 1, if all are toxic).
    The model (2**BITS weights at most) goes to the executors whole.
    """
    scorer = Scorer([tuple(r) for r in model.collect()])
    kind = dict(docs.dtypes)["doc_id"]
    offence = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sentences")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            calm = scorer.calm(flat)
            doc = np.repeat(np.arange(len(batch)), sizes)
            score = -np.expm1(-np.bincount(doc, weights=calm, minlength=len(batch)))
            first = np.cumsum(sizes) - sizes
            offending: list[list[dict]] = [[] for _ in range(len(batch))]
            for i in np.flatnonzero(score >= THRESHOLD):
                part = slice(first[i], first[i] + sizes[i])
                p = -np.expm1(-calm[part])
                ends = np.cumsum(pc.utf8_length(flat[part]).to_numpy(zero_copy_only=False))
                for s in np.flatnonzero((p >= OFFENDS) | (np.arange(len(p)) == p.argmax())):
                    text = flat[int(first[i] + s)].as_py()
                    offending[i].append({"start": int(ends[s]) - len(text), "end": int(ends[s]), "score": float(p[s]), "text": text})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(offending, offence)], names=["doc_id", "score", "offending"])

    return docs.select("doc_id", sentences_of(F.col("text")).alias("sentences")).mapInArrow(run, SCORED.format(kind))


def offending_sentences(scored: DataFrame) -> DataFrame:
    """(doc_id, start, end, score, text) of the offending sentences of score_documents() rows."""
    return scored.select("doc_id", F.explode("offending").alias("s")).select("doc_id", "s.*")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending_spans) of every document; spans as start:end, comma-joined."""
    scored = score_documents(docs, train(docs, labels))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), spans.alias("offending_spans"))
