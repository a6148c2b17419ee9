"""Text functions as columns. Only case folding with NFKC, and slugs built on it, need Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from pathlib import PurePath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veritide.functions import patterns as p

_DIGITS = str.maketrans(p.PERSIAN_DIGITS + p.ARABIC_DIGITS, "0123456789" * 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, p.TRIM, "")


def word_count(text: Column) -> Column:
    """Words and single symbols."""
    return F.regexp_count(text, F.lit(p.TOKEN))


def tokens_of(words: Column) -> Column:
    """The token count of a text of so many words and symbols, unless it is empty."""
    return F.greatest(F.lit(1), F.rint(words * 1.3).cast("int"))


def token_count(text: Column) -> Column:
    """1.3 times the words and single symbols, rounded half to even, at least 1; 0 for the empty text."""
    return F.when(text == "", F.lit(0)).otherwise(tokens_of(word_count(text)))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, p.SENTENCE_END), trim), lambda s: s != "")


def split_after(text: Column, pattern: str) -> Column:
    """Parts of text, each with the separator that ends it; joined they are the text again."""
    return F.filter(F.split(F.regexp_replace(text, pattern, "$0\u0001"), "\u0001"), lambda x: x != "")


def tokens_within(target: int) -> int:
    """The most words that count as target at most."""
    n = 1
    while round((n + 1) * 1.3) <= target:
        n += 1
    return n


def hard_split(text: Column, target: int) -> Column:
    """Longest prefixes that count as target at most, one after another."""
    piece = rf"(?s)(?:{p.SPACE}*+(?:{p.WORD}++|[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x85\p{{Z}}])){{1,{tokens_within(target)}}}+{p.SPACE}*+"
    return F.regexp_extract_all(text, F.lit(piece), 0)


def units_with_words(text: Column, target: int, paragraphs: bool = True, empty: bool = False) -> Column:
    """units() as structs (unit, words): each part's words are counted once, and no word lies across two units."""
    counted = lambda parts: F.transform(parts, lambda x: F.struct(x.alias("unit"), word_count(x).alias("words")))
    fits = lambda x: tokens_of(x["words"]) <= target
    fine = lambda s: F.when(fits(s), F.array(s)).otherwise(counted(hard_split(s["unit"], target)))
    by_sentence = lambda x: F.flatten(F.transform(counted(F.filter(F.split(x["unit"], p.UNIT_END), lambda s: s != "")), fine))
    parts = split_after(text, p.PARAGRAPH) if paragraphs else F.filter(F.array(text), lambda x: x != "")
    found = F.flatten(F.transform(counted(parts), lambda x: F.when(fits(x), F.array(x)).otherwise(by_sentence(x))))
    return F.when(text == "", F.array(F.struct(F.lit("").alias("unit"), F.lit(0).alias("words")))).otherwise(found) if empty else found


def units(text: Column, target: int, paragraphs: bool = True, empty: bool = False) -> Column:
    """Paragraphs; of those that count too much the sentences; of those still too long the hard splits.

    Without paragraphs a text is one paragraph, whatever its blank lines. An empty text has no unit, or an empty one if empty.
    """
    return F.transform(units_with_words(text, target, paragraphs, empty), lambda x: x["unit"])


def fingerprint(document_id: Column, page: Column, text: Column, length: int = 16) -> Column:
    """The first digits of SHA-256 over document, page and exact text, NUL between them."""
    nul = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(document_id.cast("string"), nul, page.cast("string"), nul, text), 256), 1, length)


def fingerprint_holds(document_id: Column, page: Column, text: Column, expected: Column) -> Column:
    """Does the expected fingerprint, of 8 to 64 digits in either case, match? False for nulls and pages below 1."""
    full = fingerprint(document_id, page, text, 64)
    same = F.substring(full, F.lit(1), F.length(expected)) == F.lower(expected)
    return F.coalesce(F.length(expected).between(8, 64) & (page >= 1) & same, F.lit(False))


def text_fingerprint(text: Column, length: int = 16) -> Column:
    """The form of fingerprints from before documents and pages were part of them: over the text alone."""
    if not 8 <= length <= 64:
        raise ValueError("length must be between 8 and 64")
    return F.substring(F.sha2(text, 256), 1, length)


def plain_citation_id(document_id: Column, page: Column, text: Column) -> Column:
    """document:pN:fingerprint; null for an empty document id and pages below 1."""
    made = F.concat_ws(":", document_id, F.concat(F.lit("p"), page.cast("string")), fingerprint(document_id, page, text))
    return F.when((document_id.cast("string") != "") & (page >= 1), made)


def plain_form(text: Column | str) -> Column:
    """NFKC with every run of blanks as one, none at the ends."""
    return by_batch(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()), "string")(text)


def fold(text: str) -> str:
    """NFKC, case folding, ASCII digits, Persian yeh and kaf, single blanks."""
    text = unicodedata.normalize("NFKC", text).casefold().translate(_DIGITS)
    return re.sub(r"[\s‌]+", " ", text.replace("ي", "ی").replace("ك", "ک")).strip()


def by_batch(f: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """f over a string column in Arrow batches; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else f(x))

    return lambda column: F.pandas_udf(run, kind)(column)


def fold_all(texts: Column | str) -> Column:
    """fold() for every element of an array; nulls stay null."""

    def run(arrays: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = (arrays.slice(at, 256).to_pylist() for at in range(0, len(arrays), 256))  # few rows at a time are Python objects
        done = [pa.array([None if xs is None else [None if x is None else fold(x) for x in xs] for xs in part], kind) for part in parts]
        return pa.concat_arrays([pa.array([], kind), *done])

    return F.arrow_udf(run, "array<string>")(texts)


def match_form(text: Column | str) -> Column:
    """fold() of a text."""
    return by_batch(fold, "string")(text)


def slug_of(filename: str, ascii_only: bool = False) -> str:
    """The stem as a slug of 64 characters at most; the head of a hash where nothing is left."""
    folded = unicodedata.normalize("NFKC", PurePath(filename).stem).casefold()
    slug = re.sub(r"[^\w]+", "-", folded).strip("-_")[:64]
    if ascii_only and not slug.isascii():
        slug = ""
    return slug or hashlib.sha256(filename.encode()).hexdigest()[:12]


def slugs(name: Column | str) -> Column:
    """slug_of() of a file name, 256 at a time as Python objects."""

    def run(names: pa.Array) -> pa.Array:
        done = [pa.array([None if x is None else slug_of(x) for x in names.slice(at, 256).to_pylist()], pa.string()) for at in range(0, len(names), 256)]
        return pa.concat_arrays([pa.array([], pa.string()), *done])

    return F.arrow_udf(run, "string")(name)


def value_tokens(text: Column) -> Column:
    """Distinct numbers, years and statistics of a text, before folding."""
    return F.array_union(F.array_union(F.regexp_extract_all(text, F.lit(p.NUMBER), 0), F.regexp_extract_all(text, F.lit(p.DATE), 0)), F.regexp_extract_all(text, F.lit(p.STAT), 0))


def quotes(text: Column) -> Column:
    """Quoted passages, trimmed, in order."""
    inner = lambda q: F.substring(q, F.lit(2), F.length(q) - 2)
    return F.transform(F.regexp_extract_all(text, F.lit(p.QUOTE), 0), lambda q: trim(inner(q)))


def without_frame(text: Column) -> Column:
    """Without one leading attribution clause, unless nothing would be left."""
    rest = F.regexp_replace(text, p.REPORTING_FRAME, "")
    return F.when(trim(rest) == "", text).otherwise(rest)
