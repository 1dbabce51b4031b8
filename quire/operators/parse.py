"""Files -> concepts: P1-P12 as one narrow (shuffle-free) Spark stage.

Input is any DataFrame with ``file_path`` and ``content`` (the scan of a
Markdown tree, a stream micro-batch, or a fixture); output has the fixed
concept schema.  Python is entered twice per row at most, in Arrow batches:
the YAML block and the body embedding.  Everything else is JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import frontmatter as fmx
from quire.functions import paths, text
from quire.functions.embedding import embed_udf
from quire.session import ship_package
from quire.schema import CONCEPT_COLUMNS, TYPE_SCHEMAS, UNKNOWN_TYPE_STATUS


def _as_column(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(v)


def resolve_status(type_col: Column, fm_status: Column, type_schemas=None) -> Column:
    """Front-matter status, else the type's default; validated when the
    type's status list is non-empty.  Types without a schema default to
    'stable' and are not validated."""
    schemas = TYPE_SCHEMAS if type_schemas is None else type_schemas
    unknown = F.coalesce(fm_status, F.lit(UNKNOWN_TYPE_STATUS))
    expr = None
    for t, (allowed, default) in schemas.items():
        dflt = F.lit(default).cast("string")
        chosen = F.coalesce(fm_status, dflt)
        if allowed:
            chosen = F.when(chosen.isin(allowed), chosen).otherwise(dflt)
        expr = F.when(type_col == t, chosen) if expr is None else expr.when(type_col == t, chosen)
    return unknown if expr is None else expr.otherwise(unknown)


def split_front_matter(files: DataFrame) -> DataFrame:
    """P1+P2: adds ``_fm`` (parsed struct) and ``body``."""
    with_block = files.withColumn("_block", fmx.front_matter_block(F.col("content")))
    parsed = with_block.withColumn("_fm", fmx.parse_yaml_udf(fmx.yaml_between("_block")))
    ok = F.col("_fm.ok")
    body = F.when(ok, F.expr("substring(content, length(_block) + 1)")).otherwise(F.col("content"))
    return parsed.withColumn("body", body).drop("_block")


def parse_files(
    files: DataFrame,
    roots: list[str],
    now=None,
    source: str = "local",
    with_embedding: bool = True,
    type_schemas=None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Build concept rows from ``files(file_path, content)``.

    ``now`` is an epoch-seconds int, a column name or a Column (the fixture
    passes a per-row clock).  ``keep`` lists extra input columns to carry.
    """
    ship_package(files.sparkSession)
    now_col = _as_column(now if now is not None else F.unix_timestamp()).cast("long")
    df = split_front_matter(files.withColumn("_now", now_col))
    fm = F.col("_fm")
    path = F.col("file_path")
    slug = paths.derive_slug(path, roots)
    ctype = paths.infer_type(path, fm["fm_type"], roots)
    body_length = text.utf16_length(F.col("body"))
    df = df.select(
        *(keep or []),
        F.xxhash64(slug).alias("id"),
        slug.alias("slug"),
        ctype.alias("type"),
        F.coalesce(fm["title"], F.lit("")).alias("title"),
        F.coalesce(fm["description"], F.lit("")).alias("description"),
        fmx.normalize_tags(fm["tags_kind"], fm["tags_items"], fm["tags_text"]).alias("tags"),
        fm["status"].alias("_fm_status"),
        fm["fm"].alias("frontmatter"),
        F.col("body"),
        body_length.alias("body_length"),
        path.alias("file_path"),
        F.sha2(F.col("content"), 256).alias("file_hash"),
        F.lit(source).alias("source"),
        fm["timestamp"].alias("timestamp"),
        fm["resource"].alias("resource"),
        F.col("_now").alias("created_at"),
        F.col("_now").alias("updated_at"),
        F.lit(None).cast("long").alias("last_synced_at"),
        fm["deps"].alias("_deps"),
    )
    df = df.withColumn("status", resolve_status(F.col("type"), F.col("_fm_status"), type_schemas))
    emb = embed_udf(F.col("body")) if with_embedding else F.lit(None).cast("array<float>")
    df = df.withColumn("embedding", emb)
    return df.select(*(keep or []), *CONCEPT_COLUMNS)


def build_concepts(files: DataFrame, roots: list[str], now=None, **kw) -> DataFrame:
    """S1/S2 scan filter followed by ``parse_files``."""
    kept = files.where(paths.scan_keeps(F.col("file_path"), roots))
    return parse_files(kept, roots, now=now, **kw)


def normalize_types(concepts: DataFrame) -> DataFrame:
    """Lowercase stored types and backfill a zero body length."""
    return concepts.withColumn("type", F.lower("type")).withColumn(
        "body_length",
        F.when(
            (F.col("body_length") == 0) & (F.col("body") != ""), F.length("body")
        ).otherwise(F.col("body_length")),
    )


def dependency_slugs(concepts: DataFrame) -> Column:
    """Declared dependencies (array) from the stored front-matter JSON.

    Non-array values mean no edges.  Used where only the snapshot is at hand.
    """
    return F.from_json(F.get_json_object(F.col("frontmatter"), "$.dependencies"), "array<string>")


def render_context(concepts: DataFrame) -> DataFrame:
    """``(type) slug: title`` + blank line + body, per concept."""
    return concepts.select(
        "slug",
        F.concat(
            F.lit("("), F.col("type"), F.lit(") "), F.col("slug"), F.lit(": "),
            F.coalesce(F.col("title"), F.lit("")), F.lit("\n\n"), F.col("body"),
        ).alias("context"),
    )
