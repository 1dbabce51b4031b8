"""Tables that change in part (S4): rows in buckets by a hash of their key.

A write stores rows by bucket under a folder of its own; a version is a small manifest that names the folders of
each bucket, one row per bucket and folder.  A run stores its new rows once; a bucket that holds none of their keys just gets one
folder more, and only of buckets with rows that the run replaces or removes (or with ``MOST_FOLDERS`` folders) the other rows are
written again.  All other files stay as they are; a reader of an older version is never disturbed.  A version exists once its manifest is
complete, so a run that ends early leaves files that nobody reads.

The number of buckets follows the rows of the first write and is doubled, rewriting the table, when
buckets have grown four times too large.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.sources import snapshot

MANIFEST_DDL = "bucket int, buckets int, folder string, n_rows long"
BUCKET_ROWS = 20_000
# A manifest and the list of buckets that a run touches have at most this many rows.
MAX_BUCKETS = 1 << 16
MOST_FOLDERS = 8
# Tasks of a write; each takes whole buckets.
MAX_TASKS = 4096
COLUMN = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Bucket of a row by the first of its keys that is not null."""
    return F.pmod(F.xxhash64(F.coalesce(*keys)), F.lit(buckets)).cast("int")


@dataclass
class Version:
    """A version of a bucketed table: where each bucket's rows are."""

    spark: SparkSession
    base: str
    name: str
    buckets: int
    folders: dict[int, tuple[tuple[str, int], ...]]  # bucket -> (folder of a write, rows) of each; empty buckets are left out
    added: str | None = None  # the folder of the rows that came with the write of this version

    @property
    def path(self) -> str:
        return f"{self.base}/{self.name}"

    @property
    def n_rows(self) -> int:
        return _rows_of(self.folders)

    def read(self, schema: StructType | str, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: other files are not listed."""
        wanted = self.folders if only is None else {b: self.folders[b] for b in only if b in self.folders}
        by_write: dict[str, list[int]] = {}
        for b, writes in wanted.items():
            for folder, _ in writes:
                by_write.setdefault(folder, []).append(b)
        paths = [f"{self.base}/data/{folder}/{COLUMN}={b}" for folder, bs in sorted(by_write.items()) for b in sorted(bs)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def fresh(self, schema: StructType | str) -> DataFrame:
        """The rows that came with the write of this version."""
        if self.added is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/data/{self.added}")


def _rows_of(folders: dict[int, tuple[tuple[str, int], ...]]) -> int:
    return sum(n for writes in folders.values() for _, n in writes)


def is_bucketed(spark: SparkSession, base: str) -> bool:
    return snapshot.exists(spark, f"{base.rstrip('/')}/data")


def versions(spark: SparkSession, base: str) -> list[str]:
    return snapshot.list_versions(spark, base)


def open_version(spark: SparkSession, base: str, name: str) -> Version:
    base = base.rstrip("/")
    rows = spark.read.schema(MANIFEST_DDL).parquet(f"{base}/{name}").collect()  # at most MOST_FOLDERS rows a bucket
    folders: dict[int, tuple[tuple[str, int], ...]] = {}
    for r in rows:
        if r.bucket is not None:
            folders[r.bucket] = (*folders.get(r.bucket, ()), (r.folder, r.n_rows))
    return Version(spark, base, name, rows[0].buckets, folders)


def current(spark: SparkSession, base: str, before: str | None = None) -> Version | None:
    """The newest version; with ``before``, the one that the version tagged so followed (the newest if no version is)."""
    names = versions(spark, base)
    if before is not None:
        tagged = [v for v in names if snapshot.tag_of(v) == before]
        names = [v for v in names if v < tagged[0]] if tagged else names
    return open_version(spark, base, names[-1]) if names else None


def _buckets_for(rows: int, bucket_rows: int) -> int:
    n = 8
    while n * bucket_rows < rows and n < MAX_BUCKETS:
        n *= 2
    return n


def _store(df: DataFrame, base: str, keys: list[str], buckets: int) -> tuple[str, dict[int, int]]:
    """Write the rows of ``df`` by bucket into a folder of their own; its name and the rows of each bucket."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex[:12]
    path = f"{base}/data/{folder}"
    order = [c for c in snapshot.SORT_WITHIN if c in df.columns]
    # By number, not by its hash: no task sorts several buckets where there are tasks enough.
    tasks = min(buckets, MAX_TASKS)
    rows = df.withColumn(COLUMN, bucket_of(keys, buckets)).repartitionById(tasks, F.pmod(F.col(COLUMN), F.lit(tasks)))
    rows.sortWithinPartitions(COLUMN, *order).write.partitionBy(COLUMN).parquet(path)
    written = spark.read.schema(f"{keys[0]} string, {COLUMN} int").parquet(path)
    return folder, {r[0]: r[1] for r in written.groupBy(COLUMN).count().collect()}  # a row per bucket


def _publish(spark: SparkSession, base: str, buckets: int, folders: dict[int, tuple[tuple[str, int], ...]], tag: str,
             added: str | None) -> Version:
    rows = [(b, buckets, folder, n) for b, writes in sorted(folders.items()) for folder, n in writes] or [(None, buckets, None, None)]
    path = snapshot.write_snapshot(spark.createDataFrame(rows, MANIFEST_DDL).coalesce(1), base, tag=tag)  # a row per bucket and folder
    return Version(spark, base, path.rsplit("/", 1)[1], buckets, folders, added)


def write(df: DataFrame, base: str, keys: list[str], tag: str = "", bucket_rows: int = BUCKET_ROWS, n_rows: int | None = None) -> Version:
    """``df`` as a whole, as the next version; ``n_rows``: how many rows it has, if that is known."""
    base = base.rstrip("/")
    buckets = _buckets_for(df.count() if n_rows is None else n_rows, bucket_rows)
    folder, counts = _store(df, base, keys, buckets)
    return _publish(df.sparkSession, base, buckets, {b: ((folder, n),) for b, n in counts.items()}, tag, folder if counts else None)


def replace(base: str, gone: DataFrame, fresh: DataFrame, keys: list[str], tag: str = "", bucket_rows: int = BUCKET_ROWS,
            old: Version | None = None, n_rows: int | None = None) -> Version:
    """The next version: without the rows whose first key is in ``gone`` or ``fresh``, and with ``fresh``.

    ``old``: the version to start from (the newest).  ``fresh`` is computed once, as it is stored (``Version.fresh``
    reads it back); ``n_rows``: how many rows it has, if that is known.
    """
    spark = fresh.sparkSession
    base = base.rstrip("/")
    old = old or current(spark, base)
    if old is None:
        return write(fresh, base, keys, tag, bucket_rows, n_rows)
    key, schema = keys[0], fresh.schema
    folder, counts = _store(fresh, base, keys, old.buckets)
    added = folder if counts else None
    fresh = Version(spark, base, "", old.buckets, {}, added).fresh(schema)
    removed = gone.select(F.col(key).cast("string").alias(key))
    moved = removed.unionByName(fresh.select(key)).where(F.col(key).isNotNull()).distinct()
    # at most MAX_BUCKETS each
    changed = {r.b for r in removed.where(F.col(key).isNotNull()).select(bucket_of([key], old.buckets).alias("b")).distinct().collect()}
    changed |= {b for b in counts if len(old.folders.get(b, ())) >= MOST_FOLDERS}
    if rest := [b for b in counts if b in old.folders and b not in changed]:
        held = old.read(f"{key} string", rest).join(moved, key, "left_semi")
        changed |= {r.b for r in held.select(bucket_of([key], old.buckets).alias("b")).distinct().collect()}
    folders = {b: writes for b, writes in old.folders.items() if b not in changed}
    if again := sorted(b for b in changed if b in old.folders):
        kept = old.read(schema, again).join(moved, key, "left_anti").select(*schema.names)
        stayed, n_kept = _store(kept, base, keys, old.buckets)
        folders |= {b: ((stayed, n),) for b, n in n_kept.items()}
    for b, n in counts.items():
        folders[b] = (*folders.get(b, ()), (folder, n))
    now = _rows_of(folders)
    if now > 4 * bucket_rows * old.buckets and old.buckets < MAX_BUCKETS:
        buckets = _buckets_for(now, bucket_rows)
        whole, counts = _store(Version(spark, base, "", old.buckets, folders).read(schema), base, keys, buckets)
        return _publish(spark, base, buckets, {b: ((whole, n),) for b, n in counts.items()}, tag, added)
    return _publish(spark, base, old.buckets, folders, tag, added)
