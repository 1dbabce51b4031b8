"""Pages of the sorted copy equal pages of the table, and read only the files that hold them."""

import uuid

from pyspark.sql import functions as F

from quire.operators import browse
from quire.session import checkpoint_dir
from quire.sources import sorted_copy


def test_pages_at_any_depth(spark):
    df = spark.range(0, 2000).select(
        "id", F.format_string("s%05d", F.col("id") * 7 % 2000).alias("slug"), F.lit("note").alias("type"), F.lit("t").alias("title"),
        F.lit("").alias("description"), F.array(F.lit("x")).alias("tags"), F.lit("draft").alias("status"), F.lit("local").alias("source"),
        F.lit(None).cast("string").alias("timestamp"), F.col("id").cast("int").alias("body_length"), F.lit(0).cast("long").alias("created_at"),
        (F.col("id") % 13).alias("updated_at")).repartition(5)
    path = f"{checkpoint_dir(spark).rstrip('/')}/sorted-{uuid.uuid4().hex}"
    sorted_copy.write_sorted(df, path, file_rows=100)
    for offset, limit in ((0, 10), (999, 150), (1990, 50), (2000, 10), (5000, 10), (None, None)):
        got = sorted_copy.page(spark, path, limit, offset)
        want = browse.list_concepts(df, limit=limit, offset=offset).select(*got.columns)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        if offset is not None and offset < 2000:
            assert len(got.inputFiles()) <= 4
    empty = path + "-empty"
    sorted_copy.write_sorted(df.limit(0), empty)
    assert sorted_copy.page(spark, empty).collect() == []
