"""U3 end to end: scan -> diff -> parse changed -> next snapshot version ->
run summary row.  Every step is a Spark job; the driver only decides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators import maintain, search_index
from quire.schema import CONCEPT_SCHEMA
from quire.session import checkpoint_dir, materialize
from quire.sources import buckets, snapshot

RUN_DDL = "run_id string, batch_id long, now long, added long, updated long, removed long, skipped long, total long"


def empty_concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CONCEPT_SCHEMA)


def current_or_empty(spark: SparkSession, base: str) -> DataFrame:
    return snapshot.read_snapshot(spark, base) if snapshot.list_versions(spark, base) else empty_concepts(spark)


def next_slugs(stored: DataFrame, diff: DataFrame) -> DataFrame:
    """(file_path, slug) of the next snapshot, known before any parsing."""
    live = diff.where(F.col("action") != "removed").select("file_path", "slug")
    pathless = stored.where(F.col("file_path").isNull()).select("file_path", "slug")
    return live.unionByName(pathless)


def _paths_of(diff: DataFrame, *actions: str) -> DataFrame:
    return diff.where(F.col("action").isin(*actions)).select("file_path")


def changed_rows(stored: DataFrame, nxt: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows that a run replaces or removes, next rows that it adds or changes): what an index must follow."""
    return (stored.join(_paths_of(diff, "updated", "removed"), "file_path", "left_semi"),
            nxt.join(_paths_of(diff, "added", "updated"), "file_path", "left_semi"))


# Rows are stored by path; rows without one by slug.
STORE_KEYS = ["file_path", "slug"]


def write_run(stored: DataFrame, scan: DataFrame, diff: DataFrame, roots: list[str], now, base: str, tag: str = "",
              old: buckets.Version | None = None) -> tuple[buckets.Version, DataFrame]:
    """The next version of the snapshot and its new and changed rows, which are parsed once, as they are stored."""
    n_fresh = _paths_of(diff, "added", "updated").count()
    written = buckets.replace(base, _paths_of(diff, "updated", "removed"), maintain.fresh_rows(scan, diff, roots, now), STORE_KEYS, tag,
                              old=old, n_rows=n_fresh)
    return written, written.fresh(CONCEPT_SCHEMA)


def run_index(files: DataFrame, roots: list[str], snapshot_base: str, now, runs_path: str | None = None,
              removals: bool = True, on_conflict: str = "fail", batch_id: int | None = None,
              slugs_path: str | None = None,
              index_base: str | None = None) -> tuple[str, DataFrame]:
    """Mirror ``files(file_path, content)`` found under ``roots`` into a new
    snapshot version; returns ``(version path, summary DataFrame)``.

    The run's ``(run_id, action, slug)`` of every added, updated and removed
    concept is appended to ``slugs_path``, the summary row to ``runs_path``; the
    stored full-text index under ``index_base`` follows the run.
    """
    spark = files.sparkSession
    run_id = uuid.uuid4().hex
    checkpoint_dir(spark)
    stored = current_or_empty(spark, snapshot_base)
    scan = files.where(paths.scan_keeps(F.col("file_path"), roots))
    diff = materialize(maintain.diff_snapshot(stored, scan, roots, removals), "diff")
    maintain.check_slug_conflicts(next_slugs(stored, diff), on_conflict)
    written, fresh = write_run(stored, scan, diff, roots, now, snapshot_base)
    summary = maintain.index_summary(diff, written.n_rows).select(
        F.lit(run_id).alias("run_id"), F.lit(batch_id).cast("long").alias("batch_id"),
        F.lit(now if isinstance(now, int) else None).cast("long").alias("now"),
        "added", "updated", "removed", "skipped", "total",
    )
    if index_base:
        gone = stored.join(_paths_of(diff, "updated", "removed"), "file_path", "left_semi")
        search_index.refresh(index_base, gone, fresh, tag=run_id)
    if slugs_path:
        changed = diff.where(F.col("action").isin("added", "updated", "removed"))
        changed.select(F.lit(run_id).alias("run_id"), "action", "slug").write.mode("append").parquet(slugs_path)
    if runs_path:
        summary.write.mode("append").parquet(runs_path)
    return written.path, summary


def scratch_base(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"
