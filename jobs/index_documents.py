"""index_documents: keeps an index of citable passages up to date as files of documents arrive.

    python -m jobs.index_documents --documents DIR --output DIR --checkpoint DIR [--config jobs/index_documents.json]

A file stream over Parquet files of documents (doc_id, text, source, ...) takes the files that its checkpoint doesn't
know yet and ends. Each micro-batch cuts its new or changed documents into pages and passages with citation ids, and writes

    output/passages   by batch and bucket: the passages of the documents taken in that batch
    output/documents  by batch: which documents the batch took, with their text's hash and number of passages

Both are written with dynamic partition overwrite, so a batch that runs again after a crash replaces its own
partitions, with the same rows. A document that arrives again unchanged is skipped; one that changed is
indexed anew, and current() shows each document as of its latest batch. Rows without a doc_id or a text can't be cited
and are counted in the log only; of rows that repeat a doc_id within a batch the one of the newest file stays.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, read_if_there
from veritide.operators.chunking import chunk_pages
from veritide.operators.layout import text_pages
from veritide.shipping import ship

log = logging.getLogger("jobs.index_documents")

TAKEN = "document_id string, document_hash string, passages bigint, batch bigint"
PASSAGES = (
    "document_id string, document_hash string, filename string, page int, section string, chunk_index int, text string, "
    "citation_id string, fingerprint string, token_count int, batch bigint, bucket int"
)


@dataclass(frozen=True)
class Config:
    """Sizes of pages and passages, and of the job's batches and output.

    paragraphs: whether blank lines part the units of passages. empty_pages: whether a page without characters has a passage, an empty one.
    """

    lines_per_page: int = 10
    chunk_size: int = 512
    chunk_overlap: int = 64
    heading: str = r"^(?:#+\s|\d+(?:\.\d+)*[.)]?\s|\p{Lu})[^.!?;,]{1,118}$"
    buckets: int = 16
    files_per_batch: int = 1000
    paragraphs: bool = True
    empty_pages: bool = False

    def __post_init__(self) -> None:
        for name in ("lines_per_page", "chunk_size", "buckets", "files_per_batch"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def arriving(spark: SparkSession, documents: str, config: Config) -> DataFrame:
    """The stream of documents, each row with the time and name of its file."""
    schema = spark.read.parquet(documents).select("doc_id", "text", "source").schema
    path = documents.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern, and a folder either way
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern)
    return rows.select("doc_id", "text", "source", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path")).alias("file"))


def fresh_documents(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(document_id, document_hash, filename, text) of arrived rows (doc_id, text, source, file) that taken doesn't have in this form.

    One shuffle by document brings copies together; what follows works on the same partitions.
    """
    named = rows.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("document_id"), "text", "source", "file")
    last = named.groupBy("document_id").agg(F.max_by(F.struct("text", "source"), F.struct("file", "text")).alias("d"))
    found = last.select("document_id", F.sha2("d.text", 256).alias("document_hash"), F.concat(F.coalesce("d.source", F.lit("unknown")), F.lit(".txt")).alias("filename"), F.col("d.text").alias("text"))
    known = taken.groupBy("document_id").agg(F.max_by("document_hash", "batch").alias("document_hash"))
    return found.join(known, ["document_id", "document_hash"], "left_anti")


def index_batch(rows: DataFrame, batch: int, output: str, config: Config) -> None:
    """Writes one batch's passages, then the list of its documents; running it again writes the same."""
    spark = rows.sparkSession
    taken = read_if_there(spark, f"{output}/documents", TAKEN).where(F.col("batch") < batch)
    fresh = fresh_documents(rows, taken).persist(StorageLevel.DISK_ONLY)
    try:
        pages = text_pages(fresh, config.lines_per_page, config.heading)
        passages = chunk_pages(pages, config.chunk_size, config.chunk_overlap, paragraphs=config.paragraphs, empty=config.empty_pages)
        hashes = fresh.select("document_id", "document_hash")
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(config.buckets)).cast("int")
        placed = passages.join(hashes, "document_id").withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": bucket})
        placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{output}/passages")
        counts = read_if_there(spark, f"{output}/passages", PASSAGES).where(F.col("batch") == batch).groupBy("document_id").agg(F.count("*").alias("passages"))
        listed = hashes.join(counts, "document_id", "left").select("document_id", "document_hash", F.coalesce("passages", F.lit(0)).alias("passages"), F.lit(batch).cast("bigint").alias("batch"))
        listed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/documents")
        read = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull() | F.col("text").isNull()).alias("left_out")).first()
        done = read_if_there(spark, f"{output}/documents", TAKEN).where(F.col("batch") == batch).agg(F.count("*"), F.coalesce(F.sum("passages"), F.lit(0))).first()
        log.info("batch %d: read %d rows (%d without id or text), wrote %d documents with %d passages to %s", batch, read["rows"], read["left_out"], *done, output)
    finally:
        fresh.unpersist()


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config = Config()) -> None:
    """Indexes the files of documents that checkpoint doesn't know yet, and returns when they are done."""
    rows = arriving(ship(spark), documents, config)
    step = lambda batch, n: index_batch(batch, n, output, config)
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("all files of %s are indexed", documents)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The passages of each document as of its latest batch. Only superseded (document, batch) pairs are joined, not the texts of the index to its list."""
    taken = read_if_there(spark, f"{output}/documents", TAKEN)
    latest = taken.groupBy("document_id").agg(F.max("batch").alias("latest"))
    gone = taken.join(latest, "document_id").where("batch < latest").select("document_id", "batch")
    return read_if_there(spark, f"{output}/passages", PASSAGES).join(gone, ["document_id", "batch"], "left_anti")


if __name__ == "__main__":
    command("index_documents: passages of documents as they arrive", ["documents", "output", "checkpoint"], Config, run)
