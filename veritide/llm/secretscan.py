"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Base patterns find assignments, access keys and long hex runs. The battery then looks at every other
run of 20 or more characters of an encoded alphabet. "=" ends a piece of a run, so names before it and
padding are no part of the next piece. Where no alphabet holds a piece ("/" or "+" beside "-" or "_"), its
longest sub-runs of each alphabet are looked at, and of those that overlap the one of the strongest evidence.
For such a token it infers the encoding (the smallest of hex, base32, base36, base62, base64 that holds it),
and weighs two things:

* The battery: chi-squared uniformity over the alphabet (null tables simulated by alphabet size and
  length, since expected counts can be below one), a runs test about the middle of the alphabet, and the lag-1 serial
  correlation, combined by Fisher's method to one p-value f of "uniform random characters of this encoding".
* The likelihood ratio of that random source to a text-like one, in which lower case, upper case, digits and signs
  come in stretches and letters have the frequencies of prose. By Markov's inequality text reaches a
  ratio of x with probability 1 / x at most, so text reaches ratio times f of x no more often.

So 1 / (ratio * f) is a p-value of "no secret here" that all three tests enter; long tokens get small ones,
short ones weak ones, and what is neither text nor random is held back by f. These p-values
go through Benjamini-Hochberg over the whole corpus, separately in bands of length, since a batch of
short identifiers must not lend its discoveries to, or take them from, long keys. They are
rounded up to a grid of half powers of two, so what is gathered from the corpus for the thresholds is one count
per band and grid step, whatever the corpus size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.cluster import cut

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+=*")
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN, ALPHA, STEPS = 20, 0.01, 60
SIMULATED, LONG, STRETCH, EVEN = 2000, 256, 0.8, 0.15
BANDS = (20, 24, 32, 48, 64)
LAYOUT = "span_start int, span_end int, kind int, band int, step int"
SCHEMA = f"doc_id bigint, spans array<struct<{LAYOUT.replace(' int', ':int')}>>"
_marks = bytes(120 if chr(i) in "+/_=-" or chr(i).isascii() and chr(i).isalnum() else 32 for i in range(256))
_hexes = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

SUB_RUNS = tuple(re.compile(rf"[{re.escape(a)}]{{{MIN_TOKEN},}}=*") for _, a in ENCODINGS)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, k: float) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    if x <= 0:
        return 1.0
    return normal_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def encoding_of(token: str) -> tuple[str, str] | None:
    """The inferred encoding; None where letters of one case alone or digits alone make it a word or a number."""
    body = token.rstrip("=")
    seen = set(body)
    classes = (any(c.islower() for c in seen), any(c.isupper() for c in seen), any(c.isdigit() for c in seen))
    if sum(classes) < 2 or len(body) < MIN_TOKEN:
        return None
    return next(((n, a) for n, a in ENCODINGS if seen <= set(a)), None)


#: Letters of English prose, in thousandths, from a to z.
PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


@lru_cache(4096)
def simulated(k: int, n: int) -> np.ndarray:
    """Sorted sums of squared counts of n uniform draws from k, the same in every process."""
    counts = np.random.default_rng(k * 1000 + n).multinomial(n, np.full(k, 1 / k), SIMULATED)
    return np.sort((counts * counts).sum(axis=1))


def uniform_p(counts: list[int], n: int) -> float:
    """Chi-squared test of uniformity; for long tokens the limit distribution."""
    k, squares = len(counts), sum(c * c for c in counts)
    if n > LONG:
        return chi2_tail(squares * k / n - n, k - 1)
    null = simulated(k, n)
    return (SIMULATED - int(np.searchsorted(null, squares)) + 1) / (SIMULATED + 1)


def kind_of(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+"


def text_source() -> dict[str, float]:
    """Probability of each character within its kind, in text: letters as in prose with a share EVEN spread evenly, others alike."""
    out = {}
    for kind in "aA0+":
        own = [c for c in CHARACTERS if kind_of(c) == kind]
        out |= {c: EVEN / len(own) + (1 - EVEN) * (PROSE[ord(c.lower()) - 97] / 1000 if kind in "aA" else 1 / len(own)) for c in own}
    return out


CHARACTERS = sorted({c for _, a in ENCODINGS for c in a})
SOURCE = text_source()


def log_ratio(body: str, alphabet: str) -> float:
    """Log-likelihood of uniform characters of the alphabet less that of text with stretches of one kind, shared among the encodings that could have been inferred."""
    out, before = -len(body) * math.log(len(alphabet)) - math.log(len(ENCODINGS)), ""
    for c in body:
        kind = kind_of(c)
        step = 1 / 4 if not before else STRETCH if kind == before else (1 - STRETCH) / 3
        out -= math.log(step * SOURCE[c])
        before = kind
    return out


def battery(token: str) -> tuple[float, float, float, float] | None:
    """P-values of uniformity, runs and serial correlation under randomness, and of "no secret" (see above)."""
    found = encoding_of(token)
    if not found:
        return None
    alphabet, body = found[1], token.rstrip("=")
    n, k = len(body), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    code = [place[c] for c in body]
    counts = [0] * k
    for c in code:
        counts[c] += 1
    uniform = uniform_p(counts, n)
    high = [c >= k / 2 for c in code]
    n1 = sum(high)
    n2 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs_p = 2 * normal_tail(abs(runs - mean) / math.sqrt(var))
    else:
        runs_p = 2.0 ** (1 - n)
    mid = sum(code) / n
    spread = sum((c - mid) ** 2 for c in code)
    serial = sum((a - mid) * (b - mid) for a, b in zip(code, code[1:], strict=False)) / spread if spread else 1.0
    serial_p = 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, min(1, runs_p), min(1, serial_p)))
    fisher = -half + math.log(1 + half + half * half / 2)  # log of the tail of chi-squared with 6 degrees of freedom at 2 * half
    no_secret = math.exp(max(-700.0, min(0.0, -log_ratio(body, alphabet) - fisher)))
    return uniform, runs_p, serial_p, no_secret


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = []
    low = raw.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_hexes):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out)


def length_band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def tested_tokens(piece: str) -> list[tuple[int, int, float]]:
    """(start, end, p-value of "no secret") of the tokens of a piece; none overlap."""

    def judged(start: int, end: int) -> tuple[int, int, float] | None:
        tested = battery(piece[start:end])
        return tested and (start, end, tested[3])

    body = set(piece.rstrip("="))
    if any(body <= set(a) for _, a in ENCODINGS):
        found = judged(0, len(piece))
        return [found] if found else []
    spans = {m.span() for run in SUB_RUNS for m in run.finditer(piece)}
    out: list[tuple[int, int, float]] = []
    for one in sorted((x for x in (judged(*s) for s in spans) if x), key=lambda x: (x[2], x[0], x[1])):
        if not any(s < one[1] and one[0] < e for s, e, _ in out):
            out.append(one)
    return sorted(out)


def candidate_spans(text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, band, grid step) of every tested token."""
    out = []
    if b"x" * MIN_TOKEN not in raw.translate(_marks):
        return out
    for m in TOKEN.finditer(text):
        for piece in PIECE.finditer(m.group()):
            if len(piece.group()) < MIN_TOKEN:
                continue
            for a, b, p in tested_tokens(piece.group()):
                start, end = m.start() + piece.start() + a, m.start() + piece.start() + b
                if any(s < end and start < e for s, e, _ in base):
                    continue
                step = min(STEPS, int(-2 * math.log2(max(p, 2.0**-100))))
                out.append((start, end, 3, length_band(end - start), step))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n.split()[0], pa.int32()) for n in LAYOUT.split(", ")]))
    names = [n.split()[0] for n in LAYOUT.split(", ")]
    for batch in batches:
        spans = []
        for value in batch.column(1):
            text = value.as_py() or ""
            raw = text.encode()
            base = base_spans(text, raw)
            rows = [(*s, -1, -1) for s in base] + candidate_spans(text, raw, base)
            spans.append([dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: (r[0], r[2]))])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])


def thresholds(counts: dict[tuple[int, int], int], alpha: float = ALPHA) -> dict[int, int]:
    """Benjamini-Hochberg per band from counts by (band, step): the least accepted step of each band with discoveries."""
    out = {}
    for band in {b for b, _ in counts}:
        total = sum(n for (b, _), n in counts.items() if b == band)
        rank, best = 0, None
        for step in range(STEPS, -1, -1):
            rank += counts.get((band, step), 0)
            if rank and 2.0 ** (-step / 2) <= alpha * rank / total:
                best = step
        if best is not None:
            out[band] = best
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, spans array<struct<span_start, span_end, kind>>) for every row; kind is one of KINDS.

    Null text counts as empty and gives no spans. Repeated rows are judged each for itself. Texts are
    read whole. The corpus sends the driver one count per length band and grid step, 400 rows at most.
    """
    found = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA))
    tested = found.select(F.explode("spans").alias("s")).where("s.kind = 3").groupBy("s.band", "s.step").count()
    limits = thresholds({(r["band"], r["step"]): r["count"] for r in tested.collect()}, alpha)
    kept = lambda s: s["kind"] < 3
    if limits:
        keep = lambda s: kept(s) | (
            (s["kind"] == 3) & (s["step"] >= F.element_at(F.create_map(*[F.lit(int(x)) for p in sorted(({b: STEPS + 1 for b in range(len(BANDS))} | limits).items()) for x in p]), s["band"]))
        )
    else:
        keep = kept
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select(
        "doc_id",
        F.transform(
            F.filter("spans", keep),
            lambda s: F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), F.get(names, s["kind"]).alias("kind")),
        ).alias("spans"),
    )


def secret_digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from secret_spans()."""
    label = lambda s: F.concat_ws(":", s["kind"], s["span_start"], s["span_end"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "random"), label), ",")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"), n("random"))
