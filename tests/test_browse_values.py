"""Values outside the fixture: folding, LIKE tags, dates, deep pages, orders."""

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import browse


def test_decomposed_and_vietnamese_words_fold(spark):
    df = spark.createDataFrame([("re\u0301sume\u0301 x\u1ea1y Été",)], "t string")
    assert df.select(text.fts_tokens(F.col("t"))).first()[0] == ["resume", "xay", "ete"]


def test_like_tags_fold_ascii_only_and_take_any_character(spark):
    df = spark.createDataFrame([(1, ["Été"]), (2, ["Red"]), (3, ["a\\b"]), (4, ["r(d"])], "id int, tags array<string>")
    hit = lambda t: [r.id for r in df.where(browse.tags_like_all([t])).collect()]
    assert hit("été") == [] and hit("rED") == [2] and hit("r_d") == [2, 4] and hit("r(d") == [4]
    assert hit("\\") == []


def test_changes_are_ordered_and_bad_dates_yield_nothing(spark):
    df = spark.createDataFrame([(i, f"s{i}", "note", "t", "stable", 86400 * i) for i in range(5)],
                               "id int, slug string, type string, title string, status string, updated_at long")
    assert [r.id for r in browse.changes_since(df, "1970-01-03").collect()] == [4, 3]
    assert [r.id for r in browse.changes_since(df, "1970-01-03T00:00:00Z").collect()] == [4, 3]
    assert browse.changes_since(df, "no date").collect() == [] and len(browse.changes_since(df, 0).collect()) == 4


def test_deep_pages_keep_their_order(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k")).repartition(7)
    order = [F.col("k").desc(), F.col("id")]
    want = [r.id for r in df.orderBy(*order).collect()][3000:3040]
    assert [r.id for r in browse.deep_page(df, order, 3000, 40).collect()] == want


def test_counts_come_largest_first(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("b", ["z", "x"])], "type string, tags array<string>")
    assert [(r.type, r["count"]) for r in browse.stats_by_type(df).collect()] == [("b", 2), ("a", 1)]
    assert [r.name for r in browse.tag_counts(df).collect()] == ["x", "y", "z"]


def test_files_are_dealt_over_more_partitions_where_the_table_has_more_splits(spark):
    from quire.sources.fixtures import SPREAD, files_from_conversations, files_from_documents

    docs = spark.range(30).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src1' AS source")
    turns = spark.range(30).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'t' AS text")
    for table, render in ((docs, lambda d: files_from_documents(d, False)), (turns, files_from_conversations)):
        files = render(table.repartition(20))
        assert files.rdd.getNumPartitions() == 20 * SPREAD and files.count() == 30
