"""Listing, filters, point reads and aggregates over a concepts DataFrame.

Q1-Q5, A1, A2, S3.  Filters are plain predicates so Catalyst pushes them into
the Parquet scan of a stored snapshot; pages are ``orderBy().offset().limit()``
which plans as a per-partition top-k (TakeOrderedAndProject), never a sort of
the whole table on one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import approx_tokens
from quire.schema import LIST_DEFAULTS

LIST_COLUMNS = [
    "id", "slug", "type", "title", "description", "tags", "status", "source",
    "timestamp", "body_length", "created_at", "updated_at",
]


def tags_like_all(tags: list[str]) -> Column:
    """Q2: every tag matches ``tags LIKE '%"t"%'`` on the JSON text.

    LIKE there is ASCII-case-insensitive and keeps '%' and '_' as wildcards,
    so the tag is used as a pattern, not a literal.
    """
    from quire.operators.maintain import like_pattern
    from quire.operators.graph import ascii_lower

    js = ascii_lower(F.to_json(F.col("tags")))
    cond = F.lit(True)
    for t in tags:
        cond = cond & js.rlike(like_pattern(f'%"{t}"%'))
    return cond


def tags_contain_all(tags: list[str]) -> Column:
    """Q3: exact containment of every tag (search form)."""
    cond = F.lit(True)
    for t in tags:
        cond = cond & F.array_contains(F.col("tags"), F.lit(t))
    return cond


def type_in(types) -> Column:
    """Q4: scalar or list; an empty list means no filter; case kept."""
    if types is None:
        return F.lit(True)
    if isinstance(types, str):
        types = [types]
    types = list(types)
    return F.col("type").isin(types) if types else F.lit(True)


def filter_concepts(concepts: DataFrame, type=None, status=None, tags=None) -> DataFrame:
    df = concepts
    if type:
        df = df.where(F.col("type") == F.lit(type))
    if status:
        df = df.where(F.col("status") == F.lit(status))
    if tags:
        df = df.where(tags_like_all(list(tags)))
    return df


def list_concepts(concepts: DataFrame, type=None, tags=None, status=None, limit=None, offset=None) -> DataFrame:
    """Q1: filtered page ordered by ``updated_at DESC`` (tie-break slug), with
    the filtered ``total`` as a scalar subquery column."""
    limit = limit or LIST_DEFAULTS["limit"]
    offset = offset or 0
    filtered = filter_concepts(concepts, type=type, status=status, tags=tags)
    total = filtered.select(F.count(F.lit(1))).scalar()
    order = [F.col("updated_at").desc(), F.col("slug")]
    if offset + limit <= DEEP_PAGE:
        page = filtered.select(*LIST_COLUMNS).orderBy(*order).offset(offset).limit(limit)
    else:
        page = deep_page(filtered.select(*LIST_COLUMNS), order, offset, limit)
    return page.select(
        *LIST_COLUMNS,
        approx_tokens(F.col("body_length")).alias("approx_tokens"),
        total.alias("total"),
    )


# Pages ending beyond this position are cut by a distributed global
# position instead of a driver-side top-k merge.
DEEP_PAGE = 100_000


def deep_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows ``offset <= position < offset + limit`` of ``df`` sorted by ``order``.

    A range-partitioned global sort, per-partition row counts (one row per
    partition), cumulative partition starts, and each row's position inside
    its partition: no row count on the driver, no single task.
    """
    from pyspark.sql import Window

    from quire.session import materialize

    # Written once, so the counts and the positions see the same partitions
    # (AQE may coalesce a re-planned sort differently).
    sorted_df = materialize(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()), "deep-page")
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start")
    )  # one row per partition
    w = Window.partitionBy("_pid").orderBy(*order)
    pos = sorted_df.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(starts), on="_pid")
    pos = pos.withColumn("_pos", F.col("_start") + F.col("_rn") - 1)
    page = pos.where((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit))
    # The page itself is sorted last: it has ``limit`` rows.
    return page.orderBy("_pos").drop("_pid", "_rn", "_start", "_pos")


def changes_since(concepts: DataFrame, since) -> DataFrame:
    """Q5: concepts updated strictly after ``since`` (epoch s or date text in UTC), the latest first.

    Text that is no date yields no rows.
    """
    if isinstance(since, (int, float)):
        ts = F.lit(int(since))
    else:
        text = str(since).strip()
        zoned = text if re.search(r"(?:Z|[+-]\d\d:?\d\d)$", text) else text + (
            " 00:00:00Z" if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else "Z")
        ts = F.unix_timestamp(F.try_to_timestamp(F.lit(zoned)))
    return (
        concepts.where(F.col("updated_at") > ts)
        .select("id", "slug", "type", "title", "status", "updated_at")
        .orderBy(F.col("updated_at").desc(), "slug")
    )


def get_by_keys(concepts: DataFrame, keys: DataFrame, key: str = "slug") -> DataFrame:
    """S3 batch form: point reads for every key of ``keys`` (inner join).

    The key table is a query batch; the join is left to AQE, which broadcasts
    it when its runtime size is small and shuffles both sides otherwise.
    """
    return concepts.join(keys.select(key).distinct(), on=key, how="inner")


def stats_by_type(concepts: DataFrame) -> DataFrame:
    """A1: count per type (with the grand total), the largest first."""
    total = concepts.select(F.count(F.lit(1))).scalar()
    return concepts.groupBy("type").agg(F.count(F.lit(1)).alias("count")).select(
        "type", "count", total.alias("total")
    ).orderBy(F.col("count").desc(), "type")


def tag_counts(concepts: DataFrame, type=None, mode: str = "distinct_arrays") -> DataFrame:
    """A2: tag -> count, the most frequent first.

    ``distinct_arrays`` (default, the reference's behaviour) counts distinct
    tag arrays; ``concepts`` counts concepts carrying the tag.
    """
    df = concepts
    if type:
        df = df.where(F.col("type") == F.lit(type))
    tags = df.select("tags")
    if mode == "distinct_arrays":
        tags = tags.distinct()
    elif mode != "concepts":
        raise ValueError(f"unknown mode {mode!r}")
    return tags.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "name")
