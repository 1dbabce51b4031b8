"""Hybrid search (H1-H5): BM25 top-k and cosine top-k per query, merged by
weight alpha, tag post-filter, ranked and paged; one plan for a whole batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.embedding import embed_udf
from quire.functions.text import approx_tokens, snippet
from quire.operators import fts, vector
from quire.operators.search_index import SearchIndex, top_documents
from quire.schema import CANDIDATE_FACTOR, MIN_CANDIDATES, SEARCH_DEFAULTS

# Bound on one broadcast query batch: queries, total query characters (a
# query has at most as many tokens as characters) and total candidates (each
# query keeps at most 2 * cand merged rows).  Larger batches are processed in
# chunks without broadcast hints.
MAX_BATCH_QUERIES = 100_000
MAX_BATCH_CHARS = 20_000_000
MAX_BATCH_CANDIDATES = 4_000_000

QUERY_DDL = "query_id long, query string, type array<string>, tags array<string>, alpha double, limit int, offset int"


def with_defaults(queries: DataFrame) -> DataFrame:
    """Fill limit/alpha/offset defaults and the candidate cut H1."""
    limit = F.when(F.coalesce(F.col("limit"), F.lit(0)) > 0, F.col("limit")).otherwise(F.lit(SEARCH_DEFAULTS["limit"]))
    out = queries.select(
        "query_id",
        F.coalesce(F.col("query"), F.lit("")).alias("query"),
        F.coalesce(F.col("type"), F.array().cast("array<string>")).alias("types"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("want_tags"),
        F.coalesce(F.col("alpha"), F.lit(SEARCH_DEFAULTS["alpha"])).cast("double").alias("alpha"),
        limit.cast("int").alias("limit"),
        F.coalesce(F.col("offset"), F.lit(0)).cast("int").alias("offset"),
    )
    return out.withColumn(
        "cand", F.greatest((F.col("offset") + F.col("limit")) * CANDIDATE_FACTOR, F.lit(MIN_CANDIDATES))
    )


def fts_candidates(concepts: DataFrame, q: DataFrame, index: SearchIndex | fts.FtsIndex | None = None,
                   broadcast: bool | None = None, k_max: int | None = None) -> DataFrame:
    """BM25 candidates per query after the type filter and cut, normalised.

    A stored index is read for the batch's terms only; without one all postings are made anew.
    """
    if isinstance(index, SearchIndex):
        top = top_documents(index, q, k_max=k_max, broadcast=broadcast)
    else:
        index = fts.build_index(concepts) if index is None else index
        phrases = fts.query_phrases(q.select("query_id", "query"))
        ranked = fts.attach_docs(fts.bm25(index.postings, phrases, index.stats, index.docs, broadcast), index.docs)
        ranked = ranked.join(fts._small(q.select("query_id", "cand", "types"), broadcast), on="query_id")
        top = fts.top_by_rank(ranked, "cand", "types", k_max=k_max)
    w = Window.partitionBy("query_id")
    norm = 1 - F.abs(F.col("rank")) / F.greatest(F.max(F.abs(F.col("rank"))).over(w), F.lit(1.0))
    return top.select("query_id", "id", "rank", "fts_pos", norm.alias("fts_norm"))


def vector_candidates(concepts: DataFrame, q: DataFrame, k_max: int | None = None) -> DataFrame:
    """Cosine candidates for queries with alpha > 0, normalised (V4)."""
    qv = q.where(F.col("alpha") > 0).select(
        "query_id", embed_udf(F.col("query")).alias("qvec"), F.col("cand").alias("k"), "types"
    )
    c = concepts.select("id", "slug", "type", "embedding")
    cands = vector.knn(c, qv, k_col="k", types_col="types", k_max=k_max)
    return vector.normalise_distance(cands).select("query_id", "id", "distance", "vec_pos", "vec_norm")


def merge(fts_c: DataFrame, vec_c: DataFrame, q: DataFrame, profile: str = "code") -> DataFrame:
    """H2+H3: full outer join by (query, id) and the weighted score.

    ``code`` (default): both sides -> (1-a)*fts + a*vec, FTS only -> fts,
    vector only -> a*vec.  ``documented``: fts = |rank|/max and the absent
    side counts 0 in (1-a)*fts + a*vec.
    """
    m = fts_c.join(vec_c, on=["query_id", "id"], how="full_outer").join(
        q.select("query_id", "alpha"), on="query_id"
    )
    a = F.col("alpha")
    if profile == "code":
        score = (
            F.when(F.col("fts_norm").isNotNull() & F.col("vec_norm").isNotNull(),
                   (1 - a) * F.col("fts_norm") + a * F.col("vec_norm"))
            .when(F.col("fts_norm").isNotNull(), F.col("fts_norm"))
            .otherwise(a * F.col("vec_norm"))
        )
    elif profile == "documented":
        fts_doc = F.coalesce(1 - F.col("fts_norm"), F.lit(0.0))
        score = (1 - a) * fts_doc + a * F.coalesce(F.col("vec_norm"), F.lit(0.0))
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return m.withColumn("score", score)


def batch_chunks(queries: DataFrame) -> list[tuple[DataFrame, int, bool]]:
    """``(chunk, largest cut, proven)`` for the parts of a query batch.

    One small aggregate over the batch proves the broadcast bound for all of it.
    A batch beyond the bound is cut by a hash of the query id to keep the
    cuts apart; a part may still hold one very deep query, so nothing of it is
    hinted and its joins are left to adaptive execution.
    """
    q = with_defaults(queries)
    stats = q.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("query")).alias("chars"),
        F.sum(2 * F.col("cand")).alias("cands"), F.max("cand").alias("k_max"),
    ).first()
    n, chars, cands = int(stats["n"] or 0), int(stats["chars"] or 0), int(stats["cands"] or 0)
    k_max = int(stats["k_max"] or MIN_CANDIDATES)
    parts = max(1, -(-n // MAX_BATCH_QUERIES), -(-chars // MAX_BATCH_CHARS), -(-cands // MAX_BATCH_CANDIDATES))
    if parts == 1:
        return [(queries, k_max, True)]
    # Hash split: every chunk gets about 1/parts of the batch, no single task.
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [(queries.where(bucket == i), k_max, False) for i in range(parts)]


def search_batch(concepts: DataFrame, queries: DataFrame, index: SearchIndex | fts.FtsIndex | None = None,
                 profile: str = "code") -> DataFrame:
    """H5 for a batch ``queries(query_id, query, type, tags, alpha, limit, offset)``.

    Returns one row per result on each query's page: ``query_id, position,
    id, slug, type, title, description, tags, status, source, body_length,
    approx_tokens, score (2 decimals), snippet, total``.
    """
    chunks = batch_chunks(queries)
    out = None
    for chunk, k_max, proven in chunks:
        part = _search_chunk(concepts, chunk, index, profile, k_max, proven)
        out = part if out is None else out.unionByName(part)
    return out


def _search_chunk(concepts: DataFrame, queries: DataFrame, index, profile: str, k_max: int, proven: bool) -> DataFrame:
    q = with_defaults(queries)
    # Query-derived tables are broadcast only where the batch's bound is proven (batch_chunks).
    small = F.broadcast if proven else (lambda df: df)
    fts_c = fts_candidates(concepts, q, index, broadcast=proven, k_max=k_max)
    vec_c = vector_candidates(concepts, q, k_max=k_max)
    merged = merge(fts_c, vec_c, q, profile)
    meta = concepts.select("id", "slug", "type", "title", "description", "tags", "status", "source", "body_length")
    # Within the bound (sum of 2 * cand) the concept table is scanned, never shuffled.
    m = small(merged.drop("slug")).join(meta, on="id").join(
        small(q.select("query_id", "want_tags", "limit", "offset")), on="query_id"
    )
    m = m.where(F.forall("want_tags", lambda t: F.array_contains(F.col("tags"), t)))
    w_all = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", 9).desc(), F.col("fts_pos").asc_nulls_last(), F.col("vec_pos").asc_nulls_last(), F.col("slug")
    )
    ranked = m.withColumn("total", F.count(F.lit(1)).over(w_all)).withColumn("position", F.row_number().over(order))
    page = ranked.where((F.col("position") > F.col("offset")) & (F.col("position") <= F.col("offset") + F.col("limit")))
    bodies = concepts.select("id", "body")
    page = small(page).join(bodies, on="id")
    return page.select(
        "query_id", (F.col("position") - F.col("offset")).alias("position"), "id", "slug", "type", "title",
        "description", "tags", "status", "source", F.coalesce("body_length", F.lit(0)).alias("body_length"),
        approx_tokens(F.col("body_length")).alias("approx_tokens"),
        F.round("score", 2).alias("score"), snippet(F.col("description"), F.col("body")).alias("snippet"), "total",
    )


def search(concepts: DataFrame, query: str, type=None, tags=None, limit=None, offset=0, alpha=None,
           **kw) -> DataFrame:
    """H5 for one query: a one-row batch."""
    spark = concepts.sparkSession
    types = [type] if isinstance(type, str) else list(type or [])
    q = spark.createDataFrame([(0, query, types, list(tags or []), alpha, limit, offset)], QUERY_DDL)
    return search_batch(concepts, q, **kw).drop("query_id")
