"""The streamed table equals the batch index, one summary per batch."""

from pyspark.sql import functions as F

from support import files_df
from quire.plans import index_run
from quire.sources import snapshot
from quire.streaming import ingest


def test_stream_latest_record_wins_and_deletes(spark):
    base = index_run.scratch_base(spark, "t-stream")
    src, snap, runs, ckpt = base + "/src", base + "/snap", base + "/runs", base + "/ckpt"
    b1 = spark.createDataFrame(
        [("/kb/a.md", "one", 1), ("/kb/a.md", "two", 2), ("/kb/b.md", "bee", 1)], ingest.RECORD_DDL
    )
    b2 = spark.createDataFrame([("/kb/b.md", None, 3), ("/kb/c.md", "sea", 3)], ingest.RECORD_DDL)
    b1.coalesce(1).write.parquet(src + "/1")
    b2.coalesce(1).write.parquet(src + "/2")
    jvm = spark.sparkContext._jvm
    for i, d in enumerate(["/1", "/2"]):
        p = jvm.org.apache.hadoop.fs.Path(src + d)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for st in fs.listStatus(p):
            fs.setTimes(st.getPath(), 1_700_000_000_000 + i * 1000, -1)
    q = ingest.start_ingest(spark, ingest.file_source(spark, src + "/*/*.parquet"), ["/kb"], snap, runs, ckpt, now=5)
    q.awaitTermination()
    final = {r.file_path: r.body for r in snapshot.read_snapshot(spark, snap).collect()}
    assert final == {"/kb/a.md": "two", "/kb/c.md": "sea"}
    summary = sorted((r.batch_id, r.added, r.removed, r.total) for r in ingest.read_runs(spark, runs).collect())
    assert summary == [(0, 2, 0, 2), (1, 1, 1, 2)]


def _batch(spark, rows):
    return spark.createDataFrame(rows, ingest.RECORD_DDL)


def test_stream_on_a_snapshot_that_batch_runs_wrote(spark):
    base = index_run.scratch_base(spark, "t-after")
    snap, runs = base + "/snap", base + "/runs"
    index_run.run_index(files_df(spark, [("/kb/a.md", "one")]), ["/kb"], snap, now=1)
    index_run.run_index(files_df(spark, [("/kb/a.md", "one"), ("/kb/b.md", "two")]), ["/kb"], snap, now=2)
    for _ in range(2):  # the second time is a replay
        ingest.process_batch(_batch(spark, [("/kb/c.md", "three", 1)]), 0, ["/kb"], snap, runs, now=3)
    assert {r.file_path for r in snapshot.read_snapshot(spark, snap).collect()} == {"/kb/a.md", "/kb/b.md", "/kb/c.md"}
    assert [(r.batch_id, r.added, r.total) for r in ingest.read_runs(spark, runs).collect()] == [(0, 1, 3)]
    assert len(snapshot.list_versions(spark, snap)) == 3
    # another stream's batch 0 is not a replay of this one
    ingest.process_batch(_batch(spark, [("/kb/d.md", "four", 1)]), 0, ["/kb"], snap, runs, now=4, stream="other")
    assert snapshot.read_snapshot(spark, snap).count() == 4


def test_a_replay_writes_a_missing_run_row(spark):
    base = index_run.scratch_base(spark, "t-crash")
    snap, runs = base + "/snap", base + "/runs"
    ingest.process_batch(_batch(spark, [("/kb/a.md", "one", 1)]), 0, ["/kb"], snap, runs, now=1)
    batch = _batch(spark, [("/kb/b.md", "two", 2), ("/kb/a.md", None, 3)])
    ingest.process_batch(batch, 1, ["/kb"], snap, base + "/lost", now=2)  # ends before its row reaches ``runs``
    ingest.process_batch(batch, 1, ["/kb"], snap, runs, now=2)
    got = {r.batch_id: (r.added, r.removed, r.total) for r in ingest.read_runs(spark, runs).collect()}
    assert got == {0: (1, 0, 1), 1: (1, 1, 1)} and len(snapshot.list_versions(spark, snap)) == 2


def test_a_path_scanned_twice_is_one_file(spark):
    base = index_run.scratch_base(spark, "t-twice")
    files = files_df(spark, [("/kb/a.md", "one"), ("/kb/a.md", "one"), ("/kb/b.md", "x"), ("/kb/b.md", "y")])
    path, summary = index_run.run_index(files, ["/kb"], base + "/snap", now=1)
    assert summary.first().added == 2
    rows = snapshot.read_version(spark, path).collect()
    assert sorted(r.file_path for r in rows) == ["/kb/a.md", "/kb/b.md"]
    _, again = index_run.run_index(files, ["/kb"], base + "/snap", now=2)
    assert (again.first().added, again.first().updated, again.first().skipped) == (0, 0, 2)


def test_late_records_and_late_deletions_lose(spark):
    base = index_run.scratch_base(spark, "t-late")
    snap, runs = base + "/snap", base + "/runs"
    batches = [
        [("/kb/a.md", "new", 10), ("/kb/b.md", None, 7), ("/kb/c.md", "x", 1), ("/kb/d.md", "late", None)],
        [("/kb/a.md", "old", 5), ("/kb/b.md", "before", 6), ("/kb/c.md", None, 1), ("/kb/d.md", "d", 0)],
        [("/kb/a.md", None, 9), ("/kb/b.md", "after", 8), ("/kb/c.md", "y", 1), ("/kb/d.md", "d", 0), ("/kb/e.md", None, 3)],
    ]
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        here, note = f"{snap}{order}", f"{runs}{order}"
        for n, i in enumerate(order):
            for _ in range(2):  # every batch is replayed
                ingest.process_batch(_batch(spark, batches[i]), n, ["/kb"], here, note, now=n)
        final = {r.file_path: r.body for r in snapshot.read_snapshot(spark, here).collect()}
        # of equal numbers content wins over a deletion, then the larger hash
        assert {k: v for k, v in final.items() if k != "/kb/c.md"} == {"/kb/a.md": "new", "/kb/b.md": "after", "/kb/d.md": "d"}
        assert final["/kb/c.md"] == max("xy", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
        assert ingest.read_runs(spark, note).count() == 3


def test_only_the_contents_of_winners_move(spark):
    records = _batch(spark, [("/kb/a.md", "old", 1), ("/kb/a.md", "new", 2), ("/kb/a.md", "new", 2), ("/kb/b.md", "x", 1), ("/kb/b.md", None, 2)])
    latest = ingest.latest_per_path(records)
    assert "content" not in latest.columns
    found = ingest.contents_of(records, latest.where("live").select("file_path", "content_hash"))
    assert [(r.file_path, r.content) for r in found.collect()] == [("/kb/a.md", "new")]
