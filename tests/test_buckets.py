"""Bucketed tables: a run writes the buckets that it changes, and versions stay readable."""

import uuid

from pyspark.sql import functions as F

from quire.session import checkpoint_dir
from quire.sources import buckets

DDL = "file_path string, slug string, body string"


def rows(spark, pairs):
    return spark.createDataFrame([(p, f"s-{p}", b) for p, b in pairs], DDL)


def got(version):
    return sorted((r.file_path or "", r.body) for r in version.read(DDL).collect())


def keys(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "file_path string")


def test_a_run_writes_only_changed_buckets(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    assert buckets.current(spark, base) is None
    first = buckets.write(rows(spark, [(f"p{i}", "one") for i in range(400)]), base, ["file_path", "slug"], bucket_rows=25)
    assert first.buckets == 16 and first.n_rows == 400
    second = buckets.replace(base, keys(spark, ["p1", "none"]), rows(spark, [("p2", "two"), ("new", "three")]), ["file_path", "slug"], bucket_rows=25)
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    where = {r[0] for r in keys(spark, ["p1", "p2", "new", "none"]).select(buckets.bucket_of(["file_path"], 16)).collect()}
    assert changed == {b for b in where if b in second.folders} and len(changed) <= 4
    want = {f"p{i}": "one" for i in range(400) if i != 1} | {"p2": "two", "new": "three"}
    assert got(second) == sorted(want.items()) and second.n_rows == 400
    assert got(first) == sorted((f"p{i}", "one") for i in range(400))  # an older version reads as before
    assert got(buckets.current(spark, base)) == got(second)
    some = second.read(DDL, [3])
    assert {r[0] for r in some.select(buckets.bucket_of(["file_path"], 16)).distinct().collect()} == {3}


def test_rows_without_a_path_are_kept_and_empty_tables_work(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    empty = rows(spark, [])
    assert buckets.replace(base, keys(spark, []), empty, ["file_path", "slug"]).n_rows == 0
    some = spark.createDataFrame([(None, "x", "remote"), (None, "y", "remote"), ("p", "p", "one")], DDL)
    assert got(buckets.replace(base, keys(spark, []), some, ["file_path", "slug"])) == [("", "remote"), ("", "remote"), ("p", "one")]
    last = buckets.replace(base, keys(spark, ["p"]), empty, ["file_path", "slug"])
    assert got(last) == [("", "remote"), ("", "remote")]
    assert got(buckets.replace(base, keys(spark, []), empty, ["file_path", "slug"])) == got(last)


def test_a_table_that_grows_gets_more_buckets(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    buckets.write(rows(spark, [("a", "1")]), base, ["file_path", "slug"], bucket_rows=2)
    big = buckets.replace(base, keys(spark, []), rows(spark, [(f"n{i}", "2") for i in range(100)]), ["file_path", "slug"], bucket_rows=2)
    assert big.buckets == 64 and big.n_rows == 101
    after = buckets.replace(base, keys(spark, ["n5"]), rows(spark, []), ["file_path", "slug"], bucket_rows=2)
    assert after.n_rows == 100 and after.read(DDL).where(F.col("file_path") == "a").count() == 1


def test_new_keys_are_added_and_no_other_row_is_written_again(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    want = {f"p{i}": "one" for i in range(60)}
    first = buckets.write(rows(spark, want.items()), base, ["file_path", "slug"])
    at = {b: w for b, w in first.folders.items()}
    new = {f"n{i}": "two" for i in range(60)}
    second = buckets.replace(base, keys(spark, []), rows(spark, new.items()), ["file_path", "slug"])
    assert all(at[b][0] in second.folders[b] and len(second.folders[b]) == 2 for b in at)
    assert got(second) == sorted((want | new).items()) and second.n_rows == 120 and got(first) == sorted(want.items())
    assert sorted((r.file_path, r.body) for r in second.fresh(DDL).collect()) == sorted(new.items())
    third = buckets.replace(base, keys(spark, []), rows(spark, [("n1", "three"), ("p1", "four")]), ["file_path", "slug"])
    want |= new | {"n1": "three", "p1": "four"}
    assert got(buckets.current(spark, base)) == got(third) == sorted(want.items()) and third.n_rows == 120


def test_a_bucket_does_not_gather_folders_without_end(spark, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_FOLDERS", 2)
    base = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    buckets.write(rows(spark, [("a", "1")]), base, ["file_path", "slug"])
    same = [r[0] for r in keys(spark, [f"k{i}" for i in range(80)] + ["a"]).select("file_path", buckets.bucket_of(["file_path"], 8).alias("b"))
            .groupBy("b").agg(F.collect_list("file_path").alias("ps")).where(F.array_contains("ps", "a")).select(F.explode("ps")).collect()]
    some = [p for p in same if p != "a"][:3]
    for p in some:
        last = buckets.replace(base, keys(spark, []), rows(spark, [(p, "2")]), ["file_path", "slug"])
    assert max(len(w) for w in last.folders.values()) <= 3 and got(last) == sorted([("a", "1")] + [(p, "2") for p in some])
