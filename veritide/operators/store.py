"""The chunk store and its manifest as DataFrames: change detection, merge, deletion, counts, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_key(source_path: Column) -> Column:
    """A document id made from its key, the same in every attempt of a task: the head of a SHA-1, in UUID form."""
    h = F.sha1(F.concat(F.lit("document:"), source_path))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def diff_sources(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """listing (source_path, current_hash) with status new, changed or unchanged, and the document_id that it has or gets."""
    old = manifest.select("source_path", F.col("document_id").alias("__id"), F.col("document_hash").alias("previous_hash"))
    rows = listing.join(old, "source_path", "left")
    status = F.when(F.col("__id").isNull(), "new").when(F.col("previous_hash") == F.col("current_hash"), "unchanged").otherwise("changed")
    return rows.withColumn("status", status).withColumn("document_id", F.coalesce("__id", document_key(F.col("source_path")))).drop("__id")


def ingest_totals(items: DataFrame) -> DataFrame:
    """One row: found, updated_chunks of the successful, and a count for every status, of items (status, chunk_count)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    done = F.col("status").isin("new", "changed")
    return items.agg(F.count("*").alias("found"), F.coalesce(F.sum(F.when(done, F.col("chunk_count"))), F.lit(0)).cast("bigint").alias("updated_chunks"), *map(n, ("new", "changed", "unchanged", "failed")))


def upsert(stored: DataFrame, arriving: DataFrame, key: str = "citation_id", order: str = "batch_pos") -> DataFrame:
    """stored with arriving rows in place of those of equal key; of arriving rows that share a key the last by order stays."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    fresh = arriving.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(stored.columns)
    return stored.join(fresh.select(key), key, "left_anti").select(stored.columns).unionByName(fresh)


def delete_documents(stored: DataFrame, doomed: DataFrame) -> DataFrame:
    """stored without the rows whose document (and hash, where doomed has one) is in doomed (document_id, document_hash)."""
    d = doomed.select(F.col("document_id").alias("__d"), F.col("document_hash").alias("__h")).distinct()
    hit = (F.col("document_id") == F.col("__d")) & (F.col("__h").isNull() | (F.col("document_hash") == F.col("__h")))
    return stored.join(d, hit, "left_anti")


def document_exists(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked (document_id) with exists: has the store a chunk of it? The store's ids meet the asked ones before any are made distinct."""
    known = chunks.join(asked.select("document_id").distinct(), "document_id", "left_semi").select("document_id").distinct()
    return asked.join(known.withColumn("exists", F.lit(True)), "document_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def indexed_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, document_hash, source_path, chunk_count) of the store; source_path is the smallest, else the file name, else empty."""
    path = F.coalesce(F.min("source_path"), F.min("filename"), F.lit(""))
    grouped = chunks.where("document_id is not null and document_hash is not null").groupBy("document_id", "document_hash")
    return grouped.agg(path.alias("source_path"), F.count("*").alias("chunk_count"))


def in_scope(path: Column, scope: str | None) -> Column:
    """Is the path the scope, or beneath it? No scope holds all."""
    if scope is None:
        return F.lit(True)
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def missing_sources(manifest: DataFrame, listing: DataFrame, scope: str | None = None) -> DataFrame:
    """Manifest entries in scope whose source is gone."""
    gone = manifest.where(in_scope(F.col("source_path"), scope)).join(listing.select("source_path"), "source_path", "left_anti")
    return gone.select("source_path", F.lit("missing_source").alias("reason"), "document_id", "document_hash", F.col("chunk_count").cast("bigint").alias("chunk_count"))


def orphans(chunks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Groups of the store that no entry of claimed (document_id, document_hash) claims, wherever they lie."""
    left = indexed_documents(chunks).join(claimed.select("document_id", "document_hash").distinct(), ["document_id", "document_hash"], "left_anti")
    path = F.coalesce(F.nullif("source_path", F.lit("")), F.col("document_id").cast("string"))
    return left.select(path.alias("source_path"), F.lit("orphan_vectors").alias("reason"), "document_id", "document_hash", "chunk_count")


def prune_report(manifest: DataFrame, chunks: DataFrame, listing: DataFrame, scope: str | None = None, dry_run: bool = False) -> DataFrame:
    """What pruning removes: missing sources first, then orphans. In both modes a missing source's chunks are reported once."""
    return missing_sources(manifest, listing, scope).unionByName(orphans(chunks, manifest))


def health(chunks: DataFrame) -> DataFrame:
    """One row: document_count (distinct, nulls ignored) and chunk_count."""
    return chunks.agg(F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count"))


def listed(manifest: DataFrame) -> DataFrame:
    """Entries by path: document_id, source_path, filename, chunk_count, indexed_at in ISO form."""
    name = F.regexp_extract("source_path", "[^/]*$", 0)
    return manifest.select("document_id", "source_path", name.alias("filename"), "chunk_count", F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("indexed_at")).orderBy("source_path")
