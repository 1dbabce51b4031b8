"""Full-text side: tokenised postings (F1/F2), corpus statistics (A3),
query rewrite (F3), phrase matching (F4) and BM25 ranking (F5).

Postings are an ordinary DataFrame ``(id, field, pos, term)`` partitioned
by document id, built once from a concept snapshot and optionally stored as a
table bucketed by id and sorted by term.  A query batch's phrases are a
small table (bounded per batch) broadcast into every partition; all heavy
work is aggregation local to a document partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import fts_tokens
from quire.schema import BM25_B, BM25_K1, BM25_MIN_IDF, FTS_FIELDS, FTS_WEIGHTS
from quire.session import materialize

# Whitespace the query rewrite splits on (JavaScript's \s set).
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def field_texts(concepts: DataFrame, *keep: str) -> DataFrame:
    """One row per (id, field): title, description, tags as JSON text, body; with the columns ``keep``."""
    parts = F.array(
        *[
            F.struct(
                F.lit(i).alias("field"),
                (F.to_json(F.col(f)) if f == "tags" else F.coalesce(F.col(f), F.lit(""))).alias("text"),
            )
            for i, f in enumerate(FTS_FIELDS)
        ]
    )
    return concepts.select("id", *keep, F.inline(parts))


# Documents of a partition whose matches one task holds, each with up to all queries of the batch.
MATCH_DOCUMENTS = 1024


def index_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def match_partitions(concepts: DataFrame) -> int:
    """Partitions for matching a batch against all of ``concepts``: more as these grow, so that a task's part does not."""
    return max(index_partitions(concepts.sparkSession), -(-concepts.count() // MATCH_DOCUMENTS))


def _by_document(concepts: DataFrame, partitions: int | None) -> DataFrame:
    n = partitions or index_partitions(concepts.sparkSession)
    return concepts.select("id", "slug", "type", *FTS_FIELDS).repartition(n, "id")


def build_postings(concepts: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(id, field, pos, term, prev, repeated)`` for every token of every field.

    ``prev`` is the token before it, and ``repeated`` says that several rows have this id.

    The index is partitioned by document id (like search shards): a query
    batch is broadcast to every partition and every per-document
    aggregation (phrase positions, term frequencies, BM25 contributions)
    runs where the postings are, without a shuffle.  A frequent term is
    spread over all partitions instead of loading one.
    """
    return _postings_of(_by_document(concepts, partitions))


def _postings_of(docs: DataFrame) -> DataFrame:
    # Inside a document's partition; not computed where nothing asks for it.
    repeated = docs.withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("id")) > 1)
    fields = field_texts(repeated, "repeated").select("id", "repeated", "field", fts_tokens(F.col("text")).alias("toks"))
    # Outer, as for the inner form Spark filters texts without tokens first, and so tokenises every text twice.
    tokens = fields.select("id", "repeated", "field", "toks", F.posexplode_outer("toks").alias("pos", "term"))
    tokens = tokens.where(F.col("term").isNotNull())
    return tokens.select("id", "field", "pos", "term", F.get("toks", F.col("pos") - 1).alias("prev"), "repeated")


def write_postings_table(postings: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store the index as a table bucketed by id and sorted by term.

    Reading it back keeps the id partitioning (no shuffle for the
    per-document aggregations) and the term order gives Parquet row-group
    statistics that skip everything but the batch's terms.
    """
    (
        postings.write.mode("errorifexists")
        .bucketBy(buckets, "id")
        .sortBy("term")
        .option("path", path)
        .saveAsTable(table)
    )
    return postings.sparkSession.table(table)


def doc_lengths(postings: DataFrame) -> DataFrame:
    """Tokens per row over all four fields (title included); rows without a
    token have no entry (their length 0 still counts in the average)."""
    return postings.groupBy("id").agg(F.count(F.lit(1)).alias("doc_len"))


def corpus_stats(concepts: DataFrame, postings: DataFrame) -> DataFrame:
    """A3: one row ``(n_docs, avg_len)`` over all rows, empty ones included."""
    n_docs = concepts.select(F.count(F.lit(1))).scalar()
    return postings.agg(F.count(F.lit(1)).alias("_n")).select(
        n_docs.alias("n_docs"), F.try_divide(F.col("_n"), n_docs).alias("avg_len")
    )


@dataclass
class FtsIndex:
    """The full-text index of a concept snapshot, partitioned by document id.

    ``docs(id, slug, type, doc_len)`` travels with the postings so ranking,
    type filtering and tie-breaking never join back to the concept table.
    """

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame

    @property
    def doc_len(self) -> DataFrame:
        return self.docs


def build_index(concepts: DataFrame, partitions: int | None = None, cache: bool = False) -> FtsIndex:
    base = _by_document(concepts, partitions)
    postings = _postings_of(base)
    if cache:
        postings = postings.cache()
    # Both sides are partitioned by id: this join does not shuffle.
    docs = doc_lengths(postings).join(base.select("id", "slug", "type"), on="id")
    stats = corpus_stats(concepts, postings)
    if cache:
        docs = docs.cache()
        stats = stats.cache()  # one row; saves re-counting the postings per query
    return FtsIndex(postings, docs, stats)


def rewrite_query(query: Column) -> Column:
    """strip double and single quotes; each whitespace-separated word is
    a phrase; OR-ed.  Returns ``array<string>`` of phrases (may hold '')."""
    cleaned = F.regexp_replace(F.regexp_replace(query, '"', ""), "'", "")
    blank = F.trim(F.regexp_replace(cleaned, JS_SPACE, " ")) == ""
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(cleaned, JS_SPACE))


def query_phrases(queries: DataFrame) -> DataFrame:
    """``(query_id, phrase_idx, pkey, toks)`` from ``queries(query_id, query)``.

    ``toks`` are the phrase's tokens and ``pkey`` their JSON text, the key
    shared by equal phrases of different queries.  Phrases with no token
    are dropped (they match nothing).
    """
    ph = queries.select("query_id", F.posexplode(rewrite_query(F.col("query"))).alias("phrase_idx", "phrase"))
    ph = ph.withColumn("toks", fts_tokens(F.col("phrase"))).where(F.size("toks") > 0)
    return ph.select("query_id", "phrase_idx", F.to_json(F.col("toks")).alias("pkey"), "toks")


# Rows of a query-derived table (phrase tokens, phrases, per-query rows)
# that may be broadcast after a count check.
MAX_BROADCAST_ROWS = 2_000_000


def _small(df: DataFrame, broadcast: bool | None) -> DataFrame:
    """Broadcast a query-derived table only behind a proven size bound.

    ``True``: the caller proved the bound (``hybrid.search_batch`` checks
    the whole batch once); ``None``: count it here (at most bound + 1 rows
    are read); ``False`` or beyond the bound: leave the join to AQE.
    """
    if broadcast is None:
        broadcast = df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return F.broadcast(df) if broadcast else df


def _phrase_keys(phrases: DataFrame) -> DataFrame:
    """Distinct phrases of a batch as ``(pkey, n_tok, tok_idx, term, before)``; ``before`` is the token before it."""
    keyed = phrases.select("pkey", "toks").dropDuplicates(["pkey"])
    tokens = keyed.select("pkey", "toks", F.size("toks").alias("n_tok"), F.posexplode("toks").alias("tok_idx", "term"))
    return tokens.withColumn("before", F.get("toks", F.col("tok_idx") - 1)).drop("toks")


def query_phrase_keys(phrases: DataFrame) -> DataFrame:
    """``(query_id, phrase_idx, pkey)``: which distinct phrase each query uses."""
    return phrases.select("query_id", "phrase_idx", "pkey")


def phrase_occurrences(postings: DataFrame, keys: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """F4 per distinct phrase: ``(pkey, id, field, occ)``.

    A posting of token j at position p votes for the start p - j; a start
    with every token of the phrase is one occurrence.  A one-token phrase needs no
    votes: all its postings in a field are counted in one group.  Of longer ones only pairs of neighbours
    (``prev`` and the term) vote, n - 1 for n tokens, so frequent words that stand apart make no rows.  Where several rows have one
    id, and for postings without ``prev``, every token votes.  Postings are
    partitioned by id, so both aggregations run without a shuffle.
    """
    joined = postings.join(_small(keys, broadcast), on="term", how="inner")
    one, need = F.col("n_tok") == 1, F.col("n_tok")  # votes for an occurrence; 0: every posting is one
    if "prev" in postings.columns:
        joined = joined.where(one | F.col("repeated") | (F.col("prev") == F.col("before")))
        need = F.when(F.col("repeated"), need).otherwise(need - 1)
    start = F.when(need > 0, F.col("pos") - F.col("tok_idx"))
    return (
        joined.groupBy("pkey", need.alias("need"), "id", "field", start.alias("start"))
        # One posting sits at position start + tok_idx, so a (start, tok_idx)
        # pair occurs at most once: a plain count equals the distinct count.
        .agg(F.count(F.lit(1)).alias("k"))
        .where((F.col("need") == 0) | (F.col("k") == F.col("need")))
        .groupBy("pkey", "id", "field")
        .agg(F.sum(F.when(F.col("need") == 0, F.col("k")).otherwise(F.lit(1))).alias("occ"))
    )


def phrase_hits(postings: DataFrame, phrases: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """per (query, phrase, id, field) the number of phrase occurrences.

    The batch's distinct phrases are numbered first (a small table, written so that the numbers stay),
    so that what is aggregated and joined per posting and per hit has numbers for keys.
    """
    distinct = phrases.select("pkey", "toks").dropDuplicates(["pkey"])
    numbered = materialize(distinct.withColumn("number", F.monotonically_increasing_id()), "phrases")
    keys = _phrase_keys(numbered.select(F.col("number").alias("pkey"), "toks"))
    used = phrases.join(numbered.select("pkey", "number"), on="pkey")
    occ = phrase_occurrences(postings, keys, broadcast)
    used = query_phrase_keys(used.select("query_id", "phrase_idx", F.col("number").alias("pkey")))
    return occ.join(_small(used, broadcast), on="pkey").drop("pkey")


def bm25(postings: DataFrame, phrases: DataFrame, stats: DataFrame, doc_len: DataFrame | None = None,
         broadcast: bool | None = None) -> DataFrame:
    """``(query_id, id, rank)`` for every row matching any phrase.

    rank = -sum_p idf_p * f * (k1+1) / (f + k1 * (1 - b + b * D / avgdl)),
    f = sum over fields of weight * occurrences (title weighs 0), idf from the
    number of rows matching the phrase in any field, floored at 1e-6.

    Each phrase's contribution depends on (phrase, row) only, so it is
    computed once per distinct phrase of the batch; queries then add up the
    contributions of their phrases at row level.
    """
    doc_len = doc_lengths(postings) if doc_len is None else doc_len
    keys = _phrase_keys(phrases)
    occ = phrase_occurrences(postings, keys, broadcast)
    weight = F.element_at(F.array(*[F.lit(FTS_WEIGHTS[f]) for f in FTS_FIELDS]), F.col("field") + 1)
    per = occ.groupBy("pkey", "id").agg(F.sum(weight * F.col("occ")).alias("f"))
    n_docs = stats.select("n_docs").scalar()
    avg_len = stats.select("avg_len").scalar()
    df_p = per.groupBy("pkey").agg(F.count(F.lit(1)).alias("n_match"))
    idf_raw = F.log((n_docs - F.col("n_match") + 0.5) / (F.col("n_match") + 0.5))
    idf = df_p.select("pkey", F.when(idf_raw <= 0, F.lit(BM25_MIN_IDF)).otherwise(idf_raw).alias("idf"))
    denom = F.col("f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / avg_len)
    # idf has one row per distinct phrase of the batch (same bound as keys).
    contrib = per.join(_small(idf, broadcast), on="pkey").join(doc_len, on="id").select(
        "pkey", "id", (F.col("idf") * F.col("f") * (BM25_K1 + 1) / denom).alias("c")
    )
    qp = _small(query_phrase_keys(phrases), broadcast)
    return contrib.join(qp, on="pkey").groupBy("query_id", "id").agg((-F.sum("c")).alias("rank"))


def attach_docs(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``slug`` and ``type`` from the index's document table (both sides
    partitioned by id: no shuffle of the concept table)."""
    return ranked.join(docs.select("id", "slug", "type"), on="id")


def top_by_rank(ranked: DataFrame, k_col: Column | str, types_col: str | None = None,
                k_max: int | None = None) -> DataFrame:
    """Type filter then per-query cut: lowest rank first, ties by slug.

    ``ranked(query_id, id, slug, type, rank, [k, types])``.  ``k_max`` (the
    largest cut of the batch) is a literal bound that lets Spark run the
    window as a partial top-k in every partition before its shuffle; the
    exact per-query cut follows.
    """
    df = ranked
    if types_col:
        df = df.where((F.size(types_col) == 0) | F.array_contains(F.col(types_col), F.col("type")))
    w = Window.partitionBy("query_id").orderBy(F.round("rank", 9), F.col("slug"))
    k = F.col(k_col) if isinstance(k_col, str) else k_col
    out = df.withColumn("fts_pos", F.row_number().over(w))
    if k_max is not None:
        out = out.where(F.col("fts_pos") <= F.lit(int(k_max)))
    return out.where(F.col("fts_pos") <= k)
