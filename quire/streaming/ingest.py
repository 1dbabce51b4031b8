"""Continuous ingest of Markdown file records with Structured Streaming.

Records ``(file_path, content, seq)`` arrive as files in a folder (or any
streaming source with that schema), in any order.  For every path the record with the highest
``seq`` wins, over all batches: a bucketed table of *heads* beside the snapshot keeps each path's
newest record number, also of deleted paths (null content deletes), so a record that comes late
or again changes nothing.  Records of equal ``seq`` are ordered too: content before a deletion, then the larger hash.
A path that a batch run indexed has no head yet, and any record wins over it.

Each micro-batch upserts its winners into the snapshot (new rows are added to their buckets; other rows are written again
only where some are replaced), then writes their heads and one summary row.  Its records are read more than once, so a
source must give the same records each time, as files and other replayable sources do.  Versions carry the stream and
batch that they were written for, so a replayed batch starts from the versions that the first attempt started from
and writes what is missing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import maintain, search_index
from quire.plans.index_run import RUN_DDL, empty_concepts, next_slugs, write_run
from quire.schema import CONCEPT_SCHEMA
from quire.sources import buckets, snapshot

RECORD_DDL = "file_path string, content string, seq long"


HEAD_DDL = "file_path string, seq long, live boolean, content_hash string"
_LEAST = -(1 << 63)


def latest_per_path(batch: DataFrame) -> DataFrame:
    """``file_path, seq, live, content_hash`` of the newest record of each path; partial maxima, so a hot path is no group."""
    known = batch.select("file_path", F.coalesce("seq", F.lit(_LEAST)).alias("seq"),
                         F.col("content").isNotNull().alias("live"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("content_hash"))
    return known.groupBy("file_path").agg(F.max(F.struct("seq", "live", "content_hash")).alias("r")).select("file_path", "r.*")


def contents_of(records: DataFrame, upserts: DataFrame) -> DataFrame:
    """``file_path, content`` of ``upserts(file_path, content_hash)``: a record of the path with that hash."""
    found = records.select("file_path", "content").join(upserts, "file_path")
    same = F.sha2("content", 256) == F.col("content_hash")
    return found.groupBy("file_path").agg(F.max_by("content", same).alias("content"))


def _buckets_of(records: DataFrame, table: buckets.Version) -> list[int]:
    """The buckets of the records' paths: at most as many as the table has."""
    return [r.b for r in records.select(buckets.bucket_of(["file_path"], table.buckets).alias("b")).distinct().collect()]


def winners(latest: DataFrame, heads: buckets.Version | None, records: DataFrame | None = None) -> DataFrame:
    """The records that are newer than the head of their path; ``records`` has the same paths, and only they are read of it."""
    if heads is None:
        return latest
    known = _buckets_of(latest if records is None else records, heads)
    stored = heads.read(HEAD_DDL, known).select("file_path", F.struct("seq", "live", "content_hash").alias("head"))
    joined = latest.join(stored, "file_path", "left")
    return joined.where(F.col("head").isNull() | (F.struct("seq", "live", "content_hash") > F.col("head"))).drop("head")


def process_batch(batch: DataFrame, batch_id: int, roots: list[str], snapshot_base: str, runs_path: str,
                  now=None, stream: str = "stream", index_base: str | None = None) -> None:
    """Upsert one micro-batch as a new version and record its heads and its run.

    ``(stream, batch_id)`` identifies the batch and is part of the versions'
    names, apart from their numbers, which follow whatever versions exist.  A
    replay finds its versions and writes only what is missing.
    """
    spark = batch.sparkSession
    from quire.functions import paths
    from quire.session import checkpoint_dir, discard, materialize

    checkpoint_dir(spark)
    run_id = f"{stream}-{batch_id}"
    base = snapshot_base.rstrip("/")
    heads_base = f"{base}-heads"
    if _has_run(spark, runs_path, run_id):
        return
    old = buckets.current(spark, base, before=run_id)
    heads = buckets.current(spark, heads_base, before=run_id)
    records = batch.where(paths.scan_keeps(F.col("file_path"), roots))
    latest = materialize(winners(latest_per_path(records), heads, records), "stream-batch")
    # Only the buckets of the batch's paths are compared.
    stored = old.read(CONCEPT_SCHEMA, _buckets_of(latest, old)) if old else empty_concepts(spark)
    # Until the changes are known, only hashes move; then the contents of changed paths do, once.
    upserts = latest.where("live").select("file_path", "content_hash")
    deletes = latest.where("not live").select("file_path")
    diff = maintain.diff_snapshot(stored, upserts, roots, removals=False).where("action <> 'kept'")
    gone = stored.join(deletes, on="file_path", how="left_semi").where(F.col("source") == maintain.LOCAL)
    diff = materialize(diff.join(gone.select("file_path"), on="file_path", how="left_anti").unionByName(
        gone.select("file_path", F.lit("removed").alias("action"), "slug", "id", "source", "created_at",
                    "last_synced_at")
    ), "stream-diff")
    mine = _tagged(spark, base, run_id)
    if mine is None:
        whole = old.read(CONCEPT_SCHEMA) if old else stored
        untouched = whole.join(diff.select("file_path"), "file_path", "left_anti").select("file_path", "slug")
        maintain.check_slug_conflicts(next_slugs(stored, diff).where("file_path is not null").unionByName(untouched))
        clock = now if now is not None else F.unix_timestamp()
        mine, _ = write_run(stored, contents_of(records, upserts), diff, roots, clock, base, run_id, old)
    if index_base:
        fresh = mine.read(CONCEPT_SCHEMA).join(diff.where(F.col("action").isin("added", "updated")).select("file_path"), "file_path", "left_semi")
        replaced = stored.join(diff.where(F.col("action").isin("updated", "removed")).select("file_path"), "file_path", "left_semi")
        search_index.refresh(index_base, replaced, fresh, tag=run_id)
    if _tagged(spark, heads_base, run_id) is None:
        fresh_heads = latest.select("file_path", "seq", "live", "content_hash")
        buckets.replace(heads_base, fresh_heads.select("file_path").limit(0), fresh_heads, ["file_path"], run_id, old=heads)
    summary = maintain.index_summary(diff, mine.n_rows).select(
        F.lit(run_id).alias("run_id"), F.lit(batch_id).cast("long").alias("batch_id"),
        F.lit(None).cast("long").alias("now"), "added", "updated", "removed", "skipped", "total",
    )
    summary.write.mode("append").parquet(runs_path)
    discard(latest, diff)


def _tagged(spark: SparkSession, base: str, tag: str) -> buckets.Version | None:
    name = next((v for v in buckets.versions(spark, base) if snapshot.tag_of(v) == tag), None)
    return buckets.open_version(spark, base, name) if name else None


def _has_run(spark: SparkSession, runs_path: str, run_id: str) -> bool:
    if not snapshot.exists(spark, runs_path):
        return False
    return not read_runs(spark, runs_path).where(F.col("run_id") == run_id).isEmpty()


def start_ingest(spark: SparkSession, source: DataFrame, roots: list[str], snapshot_base: str, runs_path: str,
                 checkpoint_location: str, available_now: bool = True, processing_time: str | None = None,
                 now=None, index_base: str | None = None):
    """Start the ingest query over a streaming ``source`` with RECORD_DDL columns; the stored index under ``index_base`` follows it."""
    # The checkpoint location is what identifies a stream over restarts.
    stream = "stream-" + hashlib.sha1(checkpoint_location.rstrip("/").encode()).hexdigest()[:10]
    writer = source.writeStream.foreachBatch(
        lambda df, bid: process_batch(df, bid, roots, snapshot_base, runs_path, now, stream, index_base)
    ).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def file_source(spark: SparkSession, path_glob: str, max_files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(RECORD_DDL).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path_glob)


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    return spark.read.schema(RUN_DDL).parquet(runs_path)
