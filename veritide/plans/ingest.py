"""Incremental ingestion and pruning over a Store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veritide.config import EngineConfig
from veritide.functions.scoring import Embedder, embedding_of
from veritide.operators import store as ops
from veritide.operators.chunking import Counter, chunk_pages
from veritide.operators.layout import mark_pages, parse_metadata
from veritide.sources.files import Extractor, Recogniser, extract_pages, recognise_sparse
from veritide.sources.tables import Store


METADATA = ("title", "author", "subject", "keywords", "creation_date")


#: Gets the name of a step and its counts: extracted (files, pages, failed, warnings), embedded (chunks), committed (new, changed, unchanged, failed, chunks).
Progress = Callable[[str, dict[str, int]], None]


def new_chunks(pages: DataFrame, embedder: Embedder, config: EngineConfig = EngineConfig(), counter: Counter | None = None) -> DataFrame:
    """Store rows of pages (document_id, document_hash, source_path, filename, page, text, headings, and metadata if the extractor gives any)."""
    return rows_of(pages, config, counter).withColumn("embedding", embedding_of(F.col("text"), embedder, config.embedding_batch_size))


def rows_of(pages: DataFrame, config: EngineConfig = EngineConfig(), counter: Counter | None = None) -> DataFrame:
    """new_chunks() without vectors: chunks with their document's title, authors, year and DOI."""
    field = (lambda n: F.element_at("metadata", n)) if "metadata" in pages.columns else (lambda n: F.lit(None).cast("string"))
    raw = pages.groupBy("document_id", "document_hash", "source_path").agg(*[F.max(field(n)).alias(n) for n in METADATA], F.max("page").alias("page_count"))
    described = parse_metadata(raw).select("document_id", "document_hash", "source_path", "meta.*", F.lit("pdf").alias("source_type"), "page_count")
    return chunk_pages(pages, config.chunk_size, config.chunk_overlap, counter, blank=False).join(described, "document_id")


def ingest(
    store: Store, listing: DataFrame, extractor: Extractor, embedder: Embedder, config: EngineConfig = EngineConfig(),
    counter: Counter | None = None, recogniser: Recogniser | None = None, on_progress: Progress | None = None,
) -> DataFrame:
    """One ingestion: (source_path, status, document_id, chunk_count, error, warnings) of every file of listing (source_path, current_hash, content).

    counter, by default the embedder's count_tokens if it has one, sizes chunks; recogniser is tried on pages with hardly any
    text; headings come from blocks where the extractor gives them. on_progress hears of each step as it ends, with counts observed on the way.

    Unchanged files are neither extracted nor embedded. New chunks replace rows of equal citation id; rows
    of a changed document's other hashes go in the same commit. A file that fails keeps what it had. Every file
    is extracted once and every chunk embedded once: both are staged beside the store, as is the report. The commit
    rewrites the buckets of new and changed documents only.
    """
    manifest = store.read("manifest")
    diff = store.stage(ops.diff_sources(listing.select("source_path", "current_hash"), manifest))
    todo = listing.join(diff.where("status <> 'unchanged'").select("source_path"), "source_path", "left_semi")
    tell = on_progress or (lambda step, counts: None)
    counter = counter or getattr(embedder, "count_tokens", None)
    read = mark_pages(recognise_sparse(store.stage(extract_pages(todo, extractor)), todo, recogniser))
    named = read.join(diff.select("source_path", "document_id"), "source_path").withColumn("document_hash", F.col("current_hash"))
    seen = Observation()
    pages = store.stage(named.observe(seen, F.count("page").alias("pages"), F.count("error").alias("failed"), F.count("warning").alias("warnings")))
    failed = pages.where("error is not null").select("source_path", "error")
    tell("extracted", {"files": todo.count(), **seen.get})
    seen = Observation()
    arriving = store.stage(new_chunks(pages.where("error is null"), embedder, config, counter).observe(seen, F.count("*").alias("chunks")))
    tell("embedded", dict(seen.get))
    done = diff.where("status <> 'unchanged'").join(failed.select("source_path"), "source_path", "left_anti")
    store.check(arriving)
    counts = arriving.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    entries = done.join(counts, "document_id", "left").select(
        "source_path", "document_id", F.col("current_hash").alias("document_hash"), F.current_timestamp().alias("indexed_at"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )
    gone = done.select("document_id")
    store.commit(
        gone,
        lambda old: ops.upsert(old.join(gone, "document_id", "left_anti"), arriving.withColumn("batch_pos", F.col("chunk_index"))),
        lambda old: old.join(done.select("source_path"), "source_path", "left_anti").unionByName(entries),
    )
    now = manifest.join(done.select("source_path"), "source_path", "left_anti").select("source_path", "chunk_count").unionByName(entries.select("source_path", "chunk_count"))
    report = diff.join(failed, "source_path", "left").join(now, "source_path", "left")
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    warned = pages.where("warning is not null").groupBy("source_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "warning"))), lambda x: x["warning"]).alias("warnings"))
    report = report.join(warned, "source_path", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    told = store.stage(report.select("source_path", status.alias("status"), "document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "error", "warnings"))
    store.unstage(keep=1)
    if on_progress:
        tell("committed", {k.removeprefix("n_"): v for k, v in ops.ingest_totals(told).first().asDict().items()})
    return told


def prune(store: Store, listing: DataFrame, scope: str | None = None, dry_run: bool = False) -> DataFrame:
    """What was, or in a dry run would be, removed, with error: entries in scope without a source, then chunks that no entry claims.

    All goes in one commit. If that fails, each bucket is tried on its own: items of buckets that can't be
    rewritten stay in the store, and have the reason as error.
    """
    report = store.stage(ops.prune_report(store.read("manifest"), store.read("chunks"), listing, scope, dry_run))
    errors: dict[int, str] = {}
    if not dry_run:
        missing = report.where("reason = 'missing_source'").select("document_id", "document_hash")
        doomed = report.select("document_id", "document_hash").distinct()
        pair = ["document_id", "document_hash"]

        def remove(touched: DataFrame) -> None:
            store.commit(touched, lambda old: old.join(doomed, pair, "left_anti"), lambda old: old.join(missing, pair, "left_anti"))

        touched = doomed.select("document_id")
        if not touched.isEmpty():
            try:
                remove(touched)
            except PySparkException:
                own = store.bucket_of(F.col("document_id"))
                for bucket in sorted(r[0] for r in touched.select(own).distinct().collect()):
                    try:
                        remove(touched.where(own == bucket))
                    except PySparkException as e:
                        errors[bucket] = str(e).split("\n")[0]
    known = store.spark.createDataFrame(list(errors.items()), "__bucket int, error string")
    told = report.withColumn("__bucket", store.bucket_of(F.col("document_id"))).join(F.broadcast(known), "__bucket", "left").drop("__bucket")
    told = store.stage(told)
    store.unstage(keep=1)
    return told
