"""PDF listings, page extraction through a pluggable extractor, drafts, and report files."""

from __future__ import annotations

import json
import os
import tempfile
import threading
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions.text import trim
from veritide.operators.layout import SPARSE_CHARS, choose_text

PDF_GLOB = "*.[pP][dD][fF]"
BLOCK = "text:string,bbox:array<double>,font_size:double,bold:boolean"
PAGES = f"source_path string, current_hash string, filename string, page int, text string, headings array<string>, blocks array<struct<{BLOCK}>>, metadata map<string,string>, error string"
#: (text, bounding box, largest font size, bold) of a block of text, in reading order.
Block = tuple[str, list[float], float, bool]
Page = tuple[int, str, list[str]] | tuple[int, str, list[Block]]
#: An extractor turns (file name, bytes) into pages of (page, text, headings or blocks), alone or with the file's metadata by field name.
Extractor = Callable[[str, bytes], list[Page] | tuple[list[Page], dict[str, str]]]
#: A recogniser turns (file name, bytes, page) into the page's text, or None where it can't work at all.
Recogniser = Callable[[str, bytes, int], str | None]
PAGE_SECONDS = 120.0


def check_path(path: str | Path) -> Path:
    """A PDF or a folder that exists; else an error."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    if path.is_file() and path.suffix.lower() != ".pdf":
        raise ValueError(f"not a PDF: {path}")
    return path


def source_key(path: Column, root: str) -> Column:
    """The path relative to root, as POSIX text; a path outside climbs by "..". """
    plain = F.regexp_replace(path, "^file:/+", "/")
    steps = [s for s in root.split("/") if s]
    out = plain
    for kept in range(len(steps) + 1):  # the longest common folder is tried last and so wins
        head = "".join(f"/{s}" for s in steps[:kept]) + "/"
        out = F.when(plain.startswith(head), F.concat(F.lit("../" * (len(steps) - kept)), F.substring(plain, len(head) + 1, 1 << 30))).otherwise(out)
    return out


def pdf_listing(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(source_path, current_hash, content) of the PDFs at or under path. Reading the hashes alone drops the contents from memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PDF_GLOB).load(str(path))
    return files.select(source_key(F.col("path"), root or str(path)).alias("source_path"), F.sha2("content", 256).alias("current_hash"), "content")


def extract_pages(listing: DataFrame, extractor: Extractor) -> DataFrame:
    """Pages of listing (source_path, current_hash, content); a file that fails gives one row with error and no page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in PAGES.split(", ")]
        fields = [f.split(":")[0] for f in BLOCK.split(",")]
        for batch in batches:
            for path, digest, content in batch.itertuples(index=False):
                name = path.rsplit("/", 1)[-1]
                try:
                    found = extractor(name, bytes(content))
                    pages, metadata = found if isinstance(found, tuple) else (found, {})
                    rows = []
                    for p, text, parts in pages:
                        heads = [x for x in parts if isinstance(x, str)]
                        blocks = [dict(zip(fields, x, strict=True)) for x in parts if not isinstance(x, str)]
                        rows.append((path, digest, name, p, text, heads, blocks or None, dict(metadata), None))
                except Exception as e:  # one bad file must not end the job
                    rows = [(path, digest, name, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return listing.select("source_path", "current_hash", "content").mapInPandas(run, PAGES)


def _within(work: Callable[[], str | None], seconds: float) -> tuple[str | None, bool]:
    """(result, in time) of work in a thread of its own, which a process's end doesn't wait for. A failure counts as no result."""
    found: list[str | None] = []

    def call() -> None:
        try:
            found.append(work())
        except Exception:  # a page that can't be recognised keeps its own text
            found.append(None)

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    return (found[0], True) if found else (None, False)


def recognise_sparse(pages: DataFrame, listing: DataFrame, recogniser: Recogniser | None, seconds: float = PAGE_SECONDS) -> DataFrame:
    """extract_pages() rows with sparse pages' text replaced where recognition gives more of it, and a column warning.

    Only sparse pages reach the recogniser, each file's once with the file's bytes; a page that takes longer than seconds counts
    as one where recognition is unavailable. A replaced page has neither headings nor blocks. Without a recogniser sparse
    pages just get their warning.
    """
    own = F.length(trim(F.coalesce("text", F.lit(""))))
    sparse = F.col("page").isNotNull() & (own < SPARSE_CHARS)
    if recogniser is None:
        rows = pages.withColumns({"recognised": F.lit(None).cast("string"), "available": F.lit(False)})
    else:
        wanted = pages.where(sparse).groupBy("source_path").agg(F.sort_array(F.collect_set("page")).alias("wanted"))
        files = listing.select("source_path", "content").join(wanted, "source_path")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, content, numbers in batch.itertuples(index=False):
                    name, raw = path.rsplit("/", 1)[-1], bytes(content)
                    for n in numbers:
                        text, _ = _within(lambda n=n, name=name, raw=raw: recogniser(name, raw, int(n)), seconds)
                        yield pd.DataFrame([(path, int(n), text, text is not None)], columns=["source_path", "page", "recognised", "available"])

        found = files.mapInPandas(run, "source_path string, page int, recognised string, available boolean")
        rows = pages.join(found, ["source_path", "page"], "left")
    chosen = choose_text(F.col("text"), F.col("recognised"), F.coalesce("available", F.lit(False)))
    rows = rows.withColumn("__c", F.when(sparse, chosen))
    replaced = F.coalesce("__c.replaced", F.lit(False))
    said = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), own.cast("string"), F.lit(" characters extracted; "), F.col("__c.warning"))
    return rows.withColumns(
        {
            "warning": said, "text": F.when(replaced, F.col("__c.text")).otherwise(F.col("text")),
            "headings": F.when(replaced, F.array().cast("array<string>")).otherwise(F.col("headings")), "blocks": F.when(~replaced, F.col("blocks")),
        }
    ).drop("__c", "recognised", "available")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """(draft_id, text) of whole UTF-8 files; the id is the path below the folder given, or the name of a single file."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    at = F.input_file_name()
    name, key = F.regexp_extract(at, "[^/]*$", 0), source_key(at, path.removeprefix("file:").rstrip("/"))
    return rows.select(F.when(key.startswith("../"), name).otherwise(key).alias("draft_id"), F.col("value").alias("text"))


def write_atomically(path: str | Path, text: str) -> Path:
    """Writes a whole file or none of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    return path


def write_json(path: str | Path, value: object) -> Path:
    return write_atomically(path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def revision_markdown(items: list[dict], note: str) -> str:
    """The readable form of a revision plan."""
    out = ["# Revision plan", "", note, ""]
    if not items:
        out.append("No claim revisions are suggested.")
    for n, item in enumerate(items, 1):
        out += [f"## {n}. {item['action']}", "", f"- **Verdict:** {item['verdict']}", f"- **Claim:** {item['text']}", f"- **Reason:** {item['reason']}"]
        if item.get("alternatives"):
            out.append(f"- **Inspect possible citations:** {', '.join(item['alternatives'])}")
        out.append("")
    return "\n".join(out).rstrip() + "\n"
