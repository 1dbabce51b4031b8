"""S1/S2 on storage: read the Markdown files under a list of roots.

Roots on a mounted file system (``file:``) are walked by tasks, one level of
directories per job, and their files are read by tasks too: the driver holds
no listing, and the walk's own rules decide which names count.  Directories that
the walk skips are never opened.

Roots in object stores and HDFS (the ``STORES`` schemes) are walked and read by tasks in the same way, through Arrow's file systems,
whose credentials are those of the executors; every name counts there too.

Roots in any other store are listed by Spark's ``binaryFile`` source, which leaves
out names that start with '_' or '.'; to index those, mount the store.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.schema import SKIP_DIR_NAMES
from quire.session import materialize

FILES_DDL = "file_path string, content string"


def _qualified(spark: SparkSession, path: str) -> str | None:
    """The root with its scheme, or None where it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString() if fs.exists(p) else None


def decoded_path(uri):
    """``file:/a/b%20c.md`` -> ``/a/b c.md`` ('+' stays a plus sign)."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The Markdown files and walkable directories directly inside each directory."""
    for pdf in batches:
        for top in pdf["path"]:
            found = []
            with os.scandir(top) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if not e.name.startswith(".") and e.name not in SKIP_DIR_NAMES:
                            found.append((e.path, True))
                    elif e.is_file(follow_symlinks=False) and e.name.endswith(".md"):
                        found.append((e.path, False))
            yield pd.DataFrame(found, columns=["path", "is_dir"]).astype({"is_dir": bool})


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with open(path, "rb") as f:  # one file at a time: memory is bounded by the largest
                yield pd.DataFrame({"file_path": [path], "content": [f.read().decode("utf-8", "replace")]})


# Schemes that Arrow's file systems open.
STORES = {"s3", "gs", "gcs", "hdfs", "abfs", "abfss"}


def _open_store(uri: str):
    """(Arrow file system, path in it) of a plain, unquoted URI."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    host, slash, path = rest.partition("/")
    return fs.FileSystem.from_uri(f"{scheme}://{host}{slash}{quote(path)}")


def _list_store_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ``_list_level``, for directories of a store."""
    from pyarrow import fs

    for pdf in batches:
        for top in pdf["path"]:
            store, path = _open_store(top)
            found = []
            for e in store.get_file_info(fs.FileSelector(path, recursive=False)):
                if e.type == fs.FileType.Directory and not e.base_name.startswith(".") and e.base_name not in SKIP_DIR_NAMES:
                    found.append((f"{top.rstrip('/')}/{e.base_name}", True))
                elif e.type == fs.FileType.File and e.base_name.endswith(".md"):
                    found.append((f"{top.rstrip('/')}/{e.base_name}", False))
            yield pd.DataFrame(found, columns=["path", "is_dir"]).astype({"is_dir": bool})


def _read_store_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for uri in pdf["path"]:
            store, path = _open_store(uri)
            with store.open_input_stream(path, compression=None) as f:
                yield pd.DataFrame({"file_path": [uri], "content": [f.read().decode("utf-8", "replace")]})


def walk_files(spark: SparkSession, roots: list[str], lister=_list_level) -> DataFrame:
    """``files(path)`` below roots; a root that is a file is itself."""
    found = [spark.createDataFrame([(r,) for r in roots if paths.is_file_root(r)], "path string")]
    level = spark.createDataFrame([(r,) for r in roots if not paths.is_file_root(r)], "path string")
    while not level.isEmpty():
        # Dealt by path: listing is latency, so a level's directories spread over all tasks.
        inside = level.repartition("path").mapInPandas(lister, "path string, is_dir boolean")
        inside = materialize(inside, "walk")
        found.append(inside.where("not is_dir").select("path"))
        level = inside.where("is_dir").select("path")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def read_store(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``files(file_path, content)`` below roots given as URIs of one of the ``STORES`` (or ``file``)."""
    roots = [r if paths.is_file_root(r) else r.rstrip("/") for r in roots]
    listed = walk_files(spark, roots, _list_store_level).where(paths.scan_keeps(F.col("path"), roots))
    return listed.repartition("path").mapInPandas(_read_store_files, FILES_DDL)


def read_markdown(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``files(file_path, content)`` for every file the roots' walk finds.

    Missing roots are skipped; a root that is a file is read as is.
    """
    known = {r: q for r in roots if (q := _qualified(spark, r))}
    local = [r for r, q in known.items() if q.startswith("file:")]
    stored = [r for r in known if r.partition("://")[0] in STORES]
    remote = [r for r in known if r not in local and r not in stored]
    files = spark.createDataFrame([], FILES_DDL)
    if local:
        plain = [r.removeprefix("file://").removeprefix("file:") for r in local]
        listed = walk_files(spark, [p if paths.is_file_root(p) else p.rstrip("/") or "/" for p in plain])
        listed = listed.where(paths.scan_keeps(F.col("path"), plain))
        files = files.union(listed.repartition("path").mapInPandas(_read_files, FILES_DDL))
    if stored:
        files = files.union(read_store(spark, stored))
    if remote:
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.md")
            .load(remote)
        )
        found = raw.select(decoded_path(F.col("path")).alias("file_path"), F.decode("content", "UTF-8").alias("content"))
        files = files.union(found.where(paths.scan_keeps(F.col("file_path"), remote)))
    return files
