"""A copy of the concept table in list order, for pages at any depth (Q1).

The copy is range-partitioned and sorted by ``updated_at`` (latest first) and slug, and a small table beside it
holds the number of rows of each file and of all files before it.  A page then reads the one
or two files that hold its rows, however deep it lies.  A filtered listing pages the same way over a copy of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import approx_tokens
from quire.operators.browse import LIST_COLUMNS
from quire.schema import LIST_DEFAULTS


def _order() -> list:
    return [F.col("updated_at").desc(), F.col("slug")]


def write_sorted(concepts: DataFrame, path: str, file_rows: int = 50_000) -> None:
    """Store ``concepts``' list columns in list order under ``path``, about ``file_rows`` a file."""
    spark = concepts.sparkSession
    files = max(1, -(-concepts.count() // file_rows))
    rows = concepts.select(*LIST_COLUMNS).repartitionByRange(files, *_order()).sortWithinPartitions(*_order())
    rows.write.parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("updated_at")).alias("late"), "slug")).alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    counts.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/files")


def page(spark: SparkSession, path: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The rows from ``offset`` on in list order, with the ``total``; only the files that hold them are read."""
    limit, offset = limit or LIST_DEFAULTS["limit"], offset or 0
    files = spark.read.parquet(f"{path}/files")
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = files.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).orderBy("start").collect()
    rows = spark.read.parquet(*[r.file for r in held]) if held else spark.read.parquet(f"{path}/rows").limit(0)
    skip = max(offset - held[0].start, 0) if held else 0
    out = rows.orderBy(*_order()).offset(skip).limit(limit)
    return out.select(*LIST_COLUMNS, approx_tokens(F.col("body_length")).alias("approx_tokens"), F.lit(total).cast("long").alias("total"))
