"""The corpus pipeline: documents in, sharded training mix out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``.

1. quality   documents whose score is below the accepting threshold go
2. dedup     one document of each near-duplicate class stays (five words, 0.8)
3. leaks     documents that hold a benchmark item within the permitted edits go
4. mix       documents are repeated or left out so that sources meet their targets
5. shards    documents get a shard and a gapless slot

Stages 2 and 3 judge rows by id and text, so one with a null ``doc_id``, or one of several texts of an id, is
judged by its own text.  Rows equal in both count once; of a class the smallest id stays, a null id last.  Documents
without a word have no share in the mix and leave there.  Columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import bin_pack, cgk_decontaminate, compress_quality, setsketch_dedup, source_mix
from quire.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier rejects.

    The labels say what good text is for these ids, so the model learns from the stage's own rows.
    """
    model = compress_quality.train(docs, table(spark, sf_dir, "labels"))
    score, good = unused(docs, "score"), unused(docs, "good")
    return compress_quality.score(docs, model, score, good).where(F.col(good) == 1).select(*docs.columns)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def rows_of(docs: DataFrame, name: str, bits: int = 63) -> DataFrame:
    """``docs`` with the column ``name``, a whole number that tells (id, text) pairs apart.

    It is a hash of the pair of ``bits`` bits.  Pairs that share their hash (about ``n * n / 2**64`` of n rows) are found by
    a second, 128-bit hash and get negative numbers of their own.
    """
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - bits)
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                    F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("null")))
    sign = unused(docs, "sign")
    keyed = docs.withColumn(name, key)
    pairs = docs.select(key.alias("k"), F.md5(text).alias("s")).distinct()
    shared = pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    if shared.isEmpty():
        return keyed
    clash = materialize(pairs.join(shared, "k").select("k", "s", (-F.row_number().over(Window.orderBy("k", "s"))).cast("long").alias("own")), "clash")
    keyed = keyed.withColumn(sign, F.md5(text))
    out = keyed.join(clash, (F.col(name) == F.col("k")) & (F.col(sign) == F.col("s")), "left")
    return out.withColumn(name, F.coalesce("own", name)).select(*docs.columns, name)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each near-duplicate class, once."""
    row = unused(docs, "row_key")
    rows = rows_of(docs, row)
    classes = setsketch_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    classes = classes.select(F.col("doc_id").alias(row), "component_id").distinct()
    named = rows.select(row, "doc_id").distinct().join(classes, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", row)).alias("first")
    keep = named.groupBy("component_id").agg(first).select(F.col("first")[row].alias(row))
    # Repeated rows of a document that stays: one of them.
    return rows.join(keep.distinct(), row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a benchmark item."""
    row = unused(docs, "row_key")
    rows = rows_of(docs, row)
    found = cgk_decontaminate.find_leaks(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source has its target share of words."""
    return source_mix.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to 16 shards of near equal size."""
    return bin_pack.pack(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("leaks", leaks), ("mix", mix), ("shards", shards)]

# No stage is expressible in SQL as a whole; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
