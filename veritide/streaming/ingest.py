"""A stream of files into a Store. An extension: the batch plan run for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritide.config import EngineConfig
from veritide.functions.scoring import Embedder
from veritide.plans.ingest import ingest
from veritide.sources.files import PDF_GLOB, Extractor, source_key
from veritide.sources.tables import Store


def watch(store: Store, path: str, extractor: Extractor, embedder: Embedder, checkpoint: str, config: EngineConfig = EngineConfig(), glob: str = PDF_GLOB, report: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Ingests files as they arrive under path. A batch that runs twice finds its files unchanged, so each file counts once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = store.spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    listing = files.select(source_key(F.col("path"), path).alias("source_path"), F.sha2("content", 256).alias("current_hash"), "content")

    def step(batch: DataFrame, _: int) -> None:
        last = batch.dropDuplicates(["source_path"])
        found = ingest(store, last, extractor, embedder, config)
        if report:
            report(found)

    return listing.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
