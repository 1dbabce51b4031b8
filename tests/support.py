"""Paths and helpers that the tests import by name."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


def files_df(spark, rows):
    return spark.createDataFrame(rows, "file_path string, content string")
