"""Fixture tables rendered from the driver's ``documents`` table.

``files_from_documents`` turns every document into a Markdown file with known
front matter, so checks can compare the parser against the attributes the
file was rendered from.  All of it is DataFrame expressions: the fixture grows
with the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture layout: roots in scan order, the explicit file
# root's content, and the epoch the fixture clock starts at.
FIXTURE_ROOTS = [
    "/kb/skills",
    "/kb/agents",
    "/kb/prompts",
    "/kb/workflows",
    "/kb/instructions",
    "/kb/knowledge",
    "/kb/notes",
    "/kb/house-rules.md",
]
HOUSE_RULES_PATH = "/kb/house-rules.md"
HOUSE_RULES_CONTENT = "---\ntitle: House rules\ndescription: Conventions for every concept\n---\nKeep each concept small.\n"
FIXTURE_EPOCH = 1704067200


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _yaml(d, m, k):
    lang, source = F.col("lang"), F.col("source")
    ds = d.cast("string")
    title = F.when(d % 3 == 0, F.concat(F.lit("title: Doc "), ds)).when(d % 3 == 1, F.concat(F.lit("name: Doc "), ds))
    desc = F.when(d % 4 == 0, F.concat(F.lit("description: About doc "), ds))
    typ = F.when(m == 6, F.lit("type: Knowledge")).when(m == 8, F.lit("type: Template"))
    tags = (
        F.when(d % 4 == 0, F.concat(F.lit("tags: ["), lang, F.lit(", "), source, F.lit("]")))
        .when(d % 4 == 1, F.concat(F.lit("tags:\n  - "), lang, F.lit("\n  - "), source))
        .when(d % 4 == 2, F.concat(F.lit("tags: "), lang, F.lit(", "), source))
    )
    status = (
        F.when(d % 5 == 0, F.lit("status: draft"))
        .when(d % 5 == 1, F.lit("status: deprecated"))
        .when(d % 5 == 2, F.lit("status: bogus"))
        .when(d % 5 == 3, F.lit("status: stable"))
    )
    deps_items = F.concat_ws(
        ", ",
        F.concat(F.lit("s"), (2 * k + 1).cast("string")),
        F.concat(F.lit("s"), (2 * k + 2).cast("string")),
        F.when(k % 5 == 0, F.concat(F.lit("ghost-"), k.cast("string"))),
        F.when((k > 0) & (k % 7 == 0), F.concat(F.lit("s"), F.floor(k / 2).cast("string"))),
    )
    deps = F.when(m == 0, F.concat(F.lit("dependencies: ["), deps_items, F.lit("]")))
    stamp = F.when(d % 6 == 0, F.lit("timestamp: 2024-01-01"))
    return F.concat_ws("\n", title, desc, typ, tags, status, deps, stamp)


def _path(d, m, k):
    ds, ks = d.cast("string"), k.cast("string")
    return (
        F.when(m == 0, F.concat(F.lit("/kb/skills/s"), ks, F.lit("/SKILL.md")))
        .when(m == 1, F.concat(F.lit("/kb/skills/s"), ks, F.lit("/references/r"), ds, F.lit(".md")))
        .when(m == 2, F.concat(F.lit("/kb/agents/a"), ds, F.lit(".md")))
        .when(m == 3, F.concat(F.lit("/kb/prompts/p"), ds, F.lit(".md")))
        .when(m == 4, F.concat(F.lit("/kb/workflows/w"), ds, F.lit(".md")))
        .when(m == 5, F.concat(F.lit("/kb/instructions/i"), ds, F.lit(".md")))
        .when(m == 6, F.concat(F.lit("/kb/knowledge/"), F.col("source"), F.lit("/k"), ds, F.lit(".md")))
        .when(m == 7, F.concat(F.lit("/kb/notes/n"), ds, F.lit(".md")))
        .when(m == 8, F.concat(F.lit("/kb/notes/"), F.col("lang"), F.lit("/n"), ds, F.lit(".md")))
        .when(d % 20 == 9, F.concat(F.lit("/kb/notes/d"), ds, F.lit("/README.md")))
        .otherwise(F.concat(F.lit("/kb/notes/node_modules/x"), ds, F.lit(".md")))
    )


def files_from_documents(documents: DataFrame, with_house_rules: bool = True, spread: bool = True) -> DataFrame:
    """``files(doc_id, file_path, content, indexed_at)`` rendered from documents."""
    d = F.col("doc_id")
    m = d % 10
    k = F.floor(d / 10)
    content = F.when(m == 7, F.col("text")).otherwise(
        F.concat(F.lit("---\n"), _yaml(d, m, k), F.lit("\n---\n"), F.col("text"))
    )
    files = documents.select(
        d.alias("doc_id"),
        _path(d, m, k).alias("file_path"),
        content.alias("content"),
        (F.lit(FIXTURE_EPOCH) + 60 * d).cast("long").alias("indexed_at"),
    )
    if with_house_rules:
        spark = documents.sparkSession
        extra = spark.createDataFrame(
            [(-1, HOUSE_RULES_PATH, HOUSE_RULES_CONTENT, FIXTURE_EPOCH - 60)],
            "doc_id long, file_path string, content string, indexed_at long",
        )
        files = files.unionByName(extra)
    if not spread:
        return files
    # The driver tables are single Parquet files: spread the rendered files
    # over the cluster by key before the per-file (Python) work.
    return files.repartition(spread_partitions(documents), "doc_id")


SPREAD = 4  # partitions per input split: rendered files are larger than their compressed rows


def spread_partitions(table: DataFrame) -> int:
    """A partition per core at least, and more as the table has more splits, so that a task's part does not grow with it."""
    return max(int(table.sparkSession.sparkContext.defaultParallelism), SPREAD * table.rdd.getNumPartitions())


def snapshot_pair(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(previous, current) file snapshots for the incremental operators.

    previous: documents with doc_id mod 11 <> 0, text + ' v1' when mod 13 = 0;
    current: documents with doc_id mod 17 <> 0, text unchanged.
    """
    d = F.col("doc_id")
    prev_docs = documents.where(d % 11 != 0).withColumn(
        "text", F.when(d % 13 == 0, F.concat(F.col("text"), F.lit(" v1"))).otherwise(F.col("text"))
    )
    cur_docs = documents.where(d % 17 != 0)
    return files_from_documents(prev_docs, False), files_from_documents(cur_docs, False)


def search_queries(benchmark: DataFrame) -> DataFrame:
    """Query batch derived from ``benchmark`` texts by word position.

    Every benchmark item yields queries covering: one frequent word, a rare
    (long) word, the whole text, a hyphenated pair, a repeated word, an accented
    and unaccented pair, quotes, blank, alpha 0 / 0.3 / 1, type lists, two tags
    and an offset past the end.  Columns:
    ``query_id, query, type, tags, alpha, limit, offset``.
    """
    words = F.split(F.regexp_replace(F.col("text"), r"[^\p{L}\p{N}\s'-]", " "), r"\s+")
    w = F.filter(words, lambda x: x != "")
    b = benchmark.select(F.col("item_id"), w.alias("w"))
    first = F.try_element_at("w", F.lit(1))
    second = F.coalesce(F.try_element_at("w", F.lit(2)), first)
    third = F.coalesce(F.try_element_at("w", F.lit(3)), first)
    longest = F.expr("aggregate(w, '', (acc, x) -> CASE WHEN length(x) > length(acc) THEN x ELSE acc END)")
    no_types = F.array().cast("array<string>")
    no_tags = F.array().cast("array<string>")
    variants = [
        # (variant, query, types, tags, alpha, limit, offset)
        (0, first, no_types, no_tags, 0.3, 10, 0),
        (1, longest, no_types, no_tags, 0.3, 10, 0),
        (2, F.array_join("w", " "), no_types, no_tags, 0.3, 10, 0),
        (3, F.concat_ws("-", first, second), no_types, no_tags, 0.3, 10, 0),
        (4, F.concat_ws(" ", second, second), no_types, no_tags, 0.3, 10, 0),
        (5, F.concat(F.lit('"'), first, F.lit("'s "), third), no_types, no_tags, 0.0, 10, 0),
        (6, F.concat_ws(" ", first, third), F.array(F.lit("skill"), F.lit("reference")), no_tags, 1.0, 10, 0),
        (7, F.concat_ws(" ", second, third), no_types, F.array(F.lit("en"), F.lit("src1")), 0.3, 10, 0),
        (8, F.concat_ws(" ", first, second), no_types, no_tags, 0.3, 5, 1000),
        (9, F.lit("   "), no_types, no_tags, 0.3, 10, 0),
        (10, F.lit("café cafe"), no_types, no_tags, 0.3, 10, 0),
        (11, F.concat_ws(" ", first, F.lit("doc")), F.array(F.lit("skill")), no_tags, 0.3, 20, 5),
        (12, F.concat_ws(" ", F.lit("the"), first), no_types, no_tags, 0.3, 10, 0),
    ]
    rows = [
        b.select(
            (F.col("item_id") * 100 + v).alias("query_id"),
            q.alias("query"),
            t.alias("type"),
            g.alias("tags"),
            F.lit(a).cast("double").alias("alpha"),
            F.lit(lim).cast("int").alias("limit"),
            F.lit(off).cast("int").alias("offset"),
        )
        for v, q, t, g, a, lim, off in variants
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def files_from_conversations(conversations: DataFrame) -> DataFrame:
    """One Markdown file per conversation turn: ``/chat/{conv_id}/{role}-{turn}.md``.

    The second search corpus: short texts without front matter.
    """
    path = F.concat(
        F.lit(CHAT_ROOT + "/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("role"), F.lit("-"),
        F.col("turn").cast("string"), F.lit(".md"),
    )
    files = conversations.select(
        path.alias("file_path"), F.col("text").alias("content"),
        (F.lit(FIXTURE_EPOCH) + 60 * F.col("conv_id") + F.col("turn")).cast("long").alias("indexed_at"),
    )
    return files.repartition(spread_partitions(conversations), "file_path")


CHAT_ROOT = "/chat"
