"""The bucketed store: what a commit rewrites, what readers see, lookups, vacuum, and pruning that fails in part."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritide.plans.ingest import prune
from veritide.sources.tables import CHUNKS, MANIFEST, Conflict, Store

N = 1000


def filled(spark, root, ids=range(N), **options):
    """A store with two chunks of each document."""
    store = Store(spark, str(root), **options)
    put(spark, store, ids, "h1")
    return store


def frames(spark, ids, digest):
    base = spark.createDataFrame([(f"d{i}", f"s/{i}.pdf") for i in ids], "document_id string, source_path string").withColumn("document_hash", F.lit(digest))
    fill = lambda schema, rows: rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in schema.split(", "))])
    chunks = base.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    chunks = chunks.withColumns({"citation_id": F.concat_ws("_", F.sha1(F.concat("document_id", "document_hash")), "page"), "text": F.concat_ws(" ", F.lit("text of"), "document_id", "document_hash"), "embedding": F.array(F.lit(1.0), F.lit(0.0))})
    return fill(CHUNKS, chunks), fill(MANIFEST, base.withColumns({"chunk_count": F.lit(2), "indexed_at": F.current_timestamp()}))


def put(spark, store, ids, digest):
    chunks, entries = frames(spark, ids, digest)
    gone = entries.select("document_id")
    swap = lambda new: lambda old: old.join(gone, "document_id", "left_anti").unionByName(new)
    store.check(chunks)
    return store.commit(gone, swap(chunks), swap(entries))


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("part-*")}


def hashes(store, version=None):
    return {r["document_id"]: r["document_hash"] for r in store.read("chunks", version=version).select("document_id", "document_hash").distinct().collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return filled(spark, tmp_path_factory.mktemp("store"))


def test_one_document_of_many_rewrites_one_bucket(spark, store):
    before, old = files(store.root), store.version()
    reader = store.read("chunks")  # opened before the commit
    version = put(spark, store, [17], "h2")
    new = set(files(store.root)) - set(before)
    assert {p.split("/")[0]: sum(q.startswith(p.split("/")[0] + "/") for q in new) for p in new} == {"chunks": 1, "manifest": 1, "snapshots": 1}
    assert before.items() <= files(store.root).items()
    assert hashes(store) == {f"d{i}": "h2" if i == 17 else "h1" for i in range(N)} and store.read("chunks").count() == 2 * N
    assert hashes(store, old)["d17"] == "h1" == {r["document_hash"] for r in reader.where("document_id = 'd17'").collect()}.pop()
    assert store.version() == version and len(store.snapshot()) == 2 * store.buckets


def test_a_commit_without_its_snapshot_is_not_seen(spark, store, monkeypatch):
    seen, version = hashes(store), store.version()
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    chunks = store.read("chunks")
    with pytest.raises(OSError, match="lost"):
        store.commit(chunks.select("document_id"), lambda old: old.limit(0), lambda old: old.limit(0))
    monkeypatch.undo()
    assert store.version() == version and hashes(store) == seen


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = filled(spark, tmp_path, range(5))

    def overtaken(old):
        put(spark, Store(spark, str(tmp_path)), [3], "other")
        return old

    with pytest.raises(Conflict):
        store.commit(store.read("chunks").select("document_id"), overtaken, lambda old: old)
    assert hashes(store)["d3"] == "other"


def test_vacuum_keeps_what_the_last_commits_name(spark, tmp_path):
    store = filled(spark, tmp_path, range(40), buckets=4)
    for i in range(3):
        put(spark, store, [i], f"h{i + 2}")
    before, n = hashes(store), len(files(tmp_path))
    last = store.versions()[-2]
    assert store.vacuum(keep=2) > 0 and len(files(tmp_path)) < n
    assert hashes(store) == before and hashes(store, last)["d2"] == "h1" and len(store.versions()) == 2
    store.vacuum()
    assert hashes(store) == before and store.vacuum() == 0
    named = {f"{t}/{v}/bucket={b}" for t, b, v, _ in store.snapshot()}
    assert {str(Path(f).parent) for f in files(tmp_path) if not f.startswith("snapshots")} == named


def test_all_documents_can_go_and_come_back(spark, tmp_path):
    store = filled(spark, tmp_path, range(6))
    ids = store.read("manifest").select("document_id")
    store.commit(ids, lambda old: old.limit(0), lambda old: old.limit(0))
    assert store.exists() and store.read("chunks").count() == 0 == store.read("manifest").count()
    put(spark, store, [1, 2], "h9")
    assert hashes(store) == {"d1": "h9", "d2": "h9"}


def scanned(frame):
    """Rows that the file scan of a collected frame gave."""
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = frame._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return sum(found)


def test_a_lookup_reads_the_row_groups_that_hold_its_id(spark, store):
    known = store.read("chunks").where("document_id = 'd5'").first()["citation_id"]
    found = store.find([known])
    [row] = found.collect()
    assert row["document_id"] == "d5" and "citation_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert scanned(found) < 200  # one bucket's rows of 2000
    missing = store.find([known[:-1] + "9"])  # inside every file's range
    assert missing.collect() == [] and scanned(missing) < 50


def test_stored_dimension_is_adopted_and_kept(spark, store):
    assert Store(spark, store.root).dimension == 2
    with pytest.raises(ValueError, match="2 dimensions"):
        Store(spark, store.root, dimension=3)
    with pytest.raises(ValueError, match="2 dimensions"):
        store.check(frames(spark, [1], "h")[0].withColumn("embedding", F.array(F.lit(1.0))))


def test_one_item_that_cannot_go_leaves_the_others_gone(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, range(30))
    bucket = store.read("manifest").select("document_id", store.bucket_of(F.col("document_id")).alias("b")).collect()
    bucket = {r["document_id"]: r["b"] for r in bucket}
    doomed = ["d1", next(d for d in bucket if bucket[d] != bucket["d1"]), next(d for d in bucket if d != "d1" and bucket[d] not in (bucket["d1"],) and bucket[d] != bucket[next(x for x in bucket if bucket[x] != bucket["d1"])])]
    listing = store.read("manifest").where(~F.col("document_id").isin(doomed)).select("source_path", F.lit("h1").alias("current_hash"))
    real = Store.commit

    def stubborn(self, touched, *changes):
        if touched.where(self.bucket_of(F.col("document_id")) == bucket["d1"]).count():
            raise PySparkException("undeletable")
        return real(self, touched, *changes)

    dry = prune(store, listing, dry_run=True).collect()
    assert sorted(r["document_id"] for r in dry) == sorted(doomed) and {r["error"] for r in dry} == {None} and store.read("manifest").count() == 30
    monkeypatch.setattr(Store, "commit", stubborn)
    report = {r["document_id"]: r["error"] for r in prune(store, listing).collect()}
    assert set(report) == set(doomed) and "undeletable" in report["d1"] and [report[d] for d in doomed[1:]] == [None, None]
    left = {r["document_id"] for r in store.read("manifest").collect()}
    assert left == set(bucket) - set(doomed[1:]) == set(hashes(store))
    monkeypatch.undo()
    assert [r["error"] for r in prune(store, listing).collect()] == [None] and prune(store, listing).count() == 0
