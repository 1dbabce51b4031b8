"""Versioned Parquet snapshots of the concept table.

A version is a directory, and readers pick the newest complete one; a version
being read is never overwritten.  A version is complete once Spark's commit
protocol has written its ``_SUCCESS`` marker.  It holds all rows, or, for tables
that runs change in part (``sources.buckets``), a manifest of the files that do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION_PREFIX = "version="


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jpath.getFileSystem(conf), jpath, jvm


def list_versions(spark: SparkSession, base: str) -> list[str]:
    """Complete version names under ``base``, oldest first (metadata only)."""
    fs, jpath, jvm = _fs(spark, base)
    if not fs.exists(jpath):
        return []
    names = []
    for st in fs.listStatus(jpath):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(VERSION_PREFIX):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                names.append(name)
    return sorted(names)


# Row order inside each written file: the common list filters (type =,
# updated_at >) then skip row groups by their min/max statistics.
SORT_WITHIN = ["type", "updated_at"]


def tag_of(version: str) -> str:
    """What a version was written for (``write_snapshot``'s tag), or an empty string."""
    return version.partition("~")[2]


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath, _ = _fs(spark, path)
    return fs.exists(jpath)


def write_snapshot(df: DataFrame, base: str, version: int | None = None, tag: str = "") -> str:
    """Write ``df`` as a new version under ``base``; return its path.

    ``tag`` names what the version is written for, so that a repeated
    attempt can find it.

    No shuffle: each task sorts its own rows before writing.
    """
    spark = df.sparkSession
    if version is None:
        existing = list_versions(spark, base)
        version = int(existing[-1][len(VERSION_PREFIX):].split("-")[0]) + 1 if existing else 1
    path = f"{base.rstrip('/')}/{VERSION_PREFIX}{version:09d}-{uuid.uuid4().hex[:8]}{'~' + tag if tag else ''}"
    cols = [c for c in SORT_WITHIN if c in df.columns]
    out = df.sortWithinPartitions(*cols) if cols else df
    out.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The concept rows of a version: its own files, or those that its manifest names."""
    from quire.schema import CONCEPT_SCHEMA
    from quire.sources import buckets

    base, _, name = path.rstrip("/").rpartition("/")
    if buckets.is_bucketed(spark, base):
        return buckets.open_version(spark, base, name).read(CONCEPT_SCHEMA)
    return spark.read.parquet(path)


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    versions = list_versions(spark, base)
    if not versions:
        raise FileNotFoundError(f"no complete snapshot under {base}")
    return read_version(spark, f"{base.rstrip('/')}/{versions[-1]}")
