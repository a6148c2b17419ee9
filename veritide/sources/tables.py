"""The store on disk: chunks and manifest in buckets of documents, written by Spark, and snapshots that say which files are current.

A commit rewrites the buckets of the documents that it touches, into a folder of its own, and then writes its snapshot,
a table of (table, bucket, commit) rows. Readers take the newest snapshot and open just the folders that
it names, so they see a commit whole or not at all, and a commit of one document among many reads and writes one bucket.
Files of chunks are sorted by citation id and carry Bloom filters and statistics of the columns that are looked up.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "document_id string, document_hash string, source_path string, filename string, title string, authors array<string>, year int, doi string, source_type string, "
    "page int, section string, chunk_index int, text string, citation_id string, fingerprint string, page_count int, embedding array<double>"
)
MANIFEST = "source_path string, document_id string, document_hash string, indexed_at timestamp, chunk_count int"
SCHEMAS = {"chunks": CHUNKS, "manifest": MANIFEST}
SNAPSHOT = "name string, bucket int, version string, dimension int"
BUCKETS = 64
#: Columns that filters and lookups name; their files get Bloom filters.
KEYED = ("citation_id", "document_id", "document_hash", "source_path", "filename", "title")
#: The bucket of the one row of a snapshot without files.
NONE = -1
Change = Callable[[DataFrame], DataFrame]


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other call uses, under spark.checkpoint.dir; a session without one, as in tests, gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="veritide-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another commit came between reading the store and writing it."""


class Store:
    """Chunks and manifest under one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, dimension: int | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._staged: list[str] = []
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stored = self._stored_dimension()
        if dimension is not None and stored is not None and dimension != stored:
            raise ValueError(f"the store has vectors of {stored} dimensions, not {dimension}")
        self.dimension = dimension if dimension is not None else stored

    # --- snapshots

    def _list(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[str]:
        """All commits that are whole, oldest first."""
        return sorted(v for v in self._list("snapshots") if self._fs.exists(self._path(f"{self.root}/snapshots/{v}/_SUCCESS")))

    def version(self) -> str | None:
        """The current commit; None before the first."""
        return max(self.versions(), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def snapshot(self, version: str | None = None) -> list[tuple[str, int, str, int | None]]:
        """(table, bucket, commit, dimension) of a commit, the current one by default: two rows a bucket at most."""
        version = version or self.version()
        if version is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshots/{version}").collect()]

    def _stored_dimension(self) -> int | None:
        return next((d for *_, d in self.snapshot() if d is not None), None)

    # --- reading

    def bucket_of(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, version: str | None = None) -> DataFrame:
        """chunks or manifest as of a commit, the current one by default, of all buckets or some; empty before the first."""
        return self._of(self.snapshot(version), name, buckets)

    def _of(self, snapshot: list, name: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/{v}/bucket={b}" for n, b, v, _ in snapshot if n == name and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def find(self, citation_ids: list[str]) -> DataFrame:
        """The chunks of some citation ids: pushed down to the files, whose statistics and Bloom filters leave out row groups without them."""
        return self.read("chunks").where(F.col("citation_id").isin(*citation_ids))

    # --- writing

    def commit(self, touched: DataFrame, chunks: Change, manifest: Change) -> str:
        """Rewrites the buckets of touched (document_id); each function turns their old rows into the new ones.

        A crash before the snapshot is written leaves the old commit. A commit that another one overtook raises Conflict;
        what it wrote is no part of any snapshot, and vacuum() takes it away.
        """
        before = self.version()
        old = self.snapshot(before)
        hit = sorted(r[0] for r in touched.where("document_id is not null").select(self.bucket_of(F.col("document_id"))).distinct().collect())
        version = f"{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
        kept = [(n, b, v) for n, b, v, _ in old if b not in hit and b != NONE]
        for name, change in (("chunks", chunks), ("manifest", manifest)):
            if not hit:
                continue
            rows = change(self._of(old, name, hit)).select(names_of(SCHEMAS[name])).withColumn("bucket", self.bucket_of(F.col("document_id")))
            by = ["citation_id"] if name == "chunks" else ["source_path"]
            # large buckets are split among tasks, small ones share one
            writer = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *by).write.partitionBy("bucket")
            for c in KEYED:
                if c in rows.columns:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
            writer.parquet(f"{self.root}/{name}/{version}")
            kept += [(name, int(d.removeprefix("bucket=")), version) for d in self._list(f"{name}/{version}") if d.startswith("bucket=")]
        if self.version() != before:
            raise Conflict(f"commit {self.version()} came in between")
        rows = [(*k, self.dimension) for k in kept] or [("", NONE, version, self.dimension)]
        self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.parquet(f"{self.root}/snapshots/{version}")
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all commits but the last keep, and files that none of these name; the number of folders deleted. Readers of older commits fail afterwards."""
        if keep < 1:
            raise ValueError("keep must be positive")
        versions = self.versions()
        used = {f"{n}/{v}/bucket={b}" for one in versions[-keep:] for n, b, v, _ in self.snapshot(one)}
        doomed = [f"snapshots/{v}" for v in versions[:-keep]]
        for name in SCHEMAS:
            for v in self._list(name):
                buckets = [f"{name}/{v}/{d}" for d in self._list(f"{name}/{v}") if d.startswith("bucket=")]
                live = [b for b in buckets if b in used]
                doomed += [f"{name}/{v}"] if not live else [b for b in buckets if b not in used]
        for folder in doomed:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(doomed)

    def stage(self, rows: DataFrame) -> DataFrame:
        """The rows written once beside the tables and read again, so that no later step computes them anew; see unstage()."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._staged.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def unstage(self, keep: int = 0) -> None:
        """Deletes what stage() wrote, but for the last keep."""
        cut = len(self._staged) - keep
        for path in self._staged[:cut]:
            self._fs.delete(self._path(path), True)
        self._staged = self._staged[cut:]

    def check(self, arriving: DataFrame) -> None:
        """Arriving vectors must have the store's dimension, where one is set; a store without one adopts theirs."""
        sizes = [r[0] for r in arriving.select(F.size("embedding")).distinct().limit(2).collect()]
        if self.dimension is None and len(sizes) == 1:
            self.dimension = sizes[0]
        if any(s != self.dimension for s in sizes):
            raise ValueError(f"vectors must have {self.dimension} dimensions")
