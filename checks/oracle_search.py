"""DuckDB oracle SQL for the search operators: tokeniser, BM25, murmur3
feature hashing, cosine KNN and the hybrid merge, written independently of
the Spark code (same definitions, plain SQL)."""

from checks.oracle_base import CONCEPTS_CTE, SNIPPET

M32 = 4294967296
C1, C2 = 0xCC9E2D51, 0x1B873593


def _mul(a, c):
    return f"CAST((CAST({a} AS HUGEINT) * {c}) % {M32} AS BIGINT)"


def _rotl(x, r):
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295)"


def _mixk(k):
    return _mul(_rotl(_mul(k, C1), 15), C2)


def _step(h, k):
    return f"(({_mul(_rotl(f'xor({h}, {k})', 13), 5)} + 3864292196) % {M32})"


def _block(i):
    return f"(b[4*{i}+1] + b[4*{i}+2]*256 + b[4*{i}+3]*65536 + b[4*{i}+4]*16777216)"


# Hash every distinct feature of ``feat(f, b)`` (b = list of byte values).
MURMUR_CTES = f"""
mm1 AS (SELECT f, b, len(b) AS l, len(b) // 4 AS nb FROM feat),
mm2 AS (
  SELECT f, l,
    list_reduce(list_transform(range(nb), lambda i: {_mixk(_block('i'))}), lambda h, k: {_step('h', 'k')}, 0) AS h0,
    CASE l % 4 WHEN 0 THEN 0
      WHEN 1 THEN b[4*nb+1]
      WHEN 2 THEN b[4*nb+1] + b[4*nb+2]*256
      ELSE b[4*nb+1] + b[4*nb+2]*256 + b[4*nb+3]*65536 END AS t
  FROM mm1),
mm3 AS (SELECT f, xor(CASE WHEN l % 4 > 0 THEN xor(h0, {_mixk('t')}) ELSE h0 END, l) AS h FROM mm2),
mm4 AS (SELECT f, {_mul('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM mm3),
mm5 AS (SELECT f, {_mul('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM mm4),
hashed AS (SELECT f, xor(h, h >> 16) AS hash FROM mm5)"""

BYTES = "list_transform(string_split({x}, ''), lambda ch: ascii(ch))"


def _bytes(x):
    return BYTES.format(x=x)


# Embedding tokens: lowercase, split on anything but ASCII word chars and "'".
ETOKS = "list_filter(regexp_split_to_array(lower({x}), '[^A-Za-z0-9_'']+'), lambda t: t <> '')"
FTOKS = "regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def etoks(x):
    return ETOKS.format(x=x)


def ftoks(x):
    return FTOKS.format(x=x)


def embed_ctes(src: str, key: str, text: str, prefix: str) -> str:
    """CTEs ``{prefix}vec(key, bin, v)`` of the L2-normalised float vectors."""
    return f"""
{prefix}tok AS (SELECT {key} AS key, {etoks(text)} AS t FROM {src}),
{prefix}feat AS (
  SELECT key, unnest(t) AS f, 0 AS kind FROM {prefix}tok
  UNION ALL
  SELECT key, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '|' || t[i+1])) AS f, 1 FROM {prefix}tok
),
{prefix}cnt AS (
  SELECT key, CAST(h.hash % 256 AS INTEGER) AS bin, sum(CASE WHEN h.hash % 2 = 1 THEN 1 ELSE -1 END) AS c
  FROM {prefix}feat x JOIN hashed h ON h.f = x.f GROUP BY 1, 2),
{prefix}nrm AS (SELECT key, sqrt(sum(c * c)) AS n FROM {prefix}cnt GROUP BY 1),
{prefix}vec AS (
  SELECT c.key, c.bin, CAST(CAST(c.c / n.n AS FLOAT) AS DOUBLE) AS v
  FROM {prefix}cnt c JOIN {prefix}nrm n USING (key) WHERE n.n > 0 AND c.c <> 0)"""


def feat_from(tok_tables: list[str]) -> str:
    """``feat(f, b)``: distinct unigram/bigram features (bigram join byte 0)."""
    parts = []
    for t in tok_tables:
        parts.append(f"SELECT unnest(t) AS f FROM {t}")
        parts.append(f"SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '|' || t[i+1])) FROM {t}")
    union = " UNION ".join(parts)
    # '|' marks the bigram join; the hashed bytes use 0 there, as the reference does.
    return f"""
featd AS ({union}),
feat AS (
  SELECT f, CASE WHEN contains(f, '|') THEN list_concat({_bytes("split_part(f, '|', 1)")}, [0],
                                                      {_bytes("split_part(f, '|', 2)")})
                 ELSE {_bytes('f')} END AS b
  FROM featd)"""


QUERIES_CTE = """
bw AS (
  SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^\\p{L}\\p{N}\\s''-]', ' ', 'g'), '\\s+'),
                              lambda x: x <> '') AS w
  FROM benchmark),
bq AS (
  SELECT item_id, w, w[1] AS w1, coalesce(w[2], w[1]) AS w2, coalesce(w[3], w[1]) AS w3,
    list_reduce(w, lambda acc, x: CASE WHEN length(x) > length(acc) THEN x ELSE acc END, '') AS wl
  FROM bw),
rawq AS (
  SELECT item_id * 100 + v AS query_id,
    CASE v WHEN 0 THEN w1 WHEN 1 THEN wl WHEN 2 THEN array_to_string(w, ' ') WHEN 3 THEN concat_ws('-', w1, w2)
           WHEN 4 THEN concat_ws(' ', w2, w2) WHEN 5 THEN '"' || w1 || '''s ' || w3
           WHEN 6 THEN concat_ws(' ', w1, w3) WHEN 7 THEN concat_ws(' ', w2, w3) WHEN 8 THEN concat_ws(' ', w1, w2)
           WHEN 9 THEN '   ' WHEN 10 THEN 'café cafe' WHEN 11 THEN concat_ws(' ', w1, 'doc')
           ELSE concat_ws(' ', 'the', w1) END AS query,
    CASE v WHEN 6 THEN ['skill', 'reference'] WHEN 11 THEN ['skill'] ELSE []::VARCHAR[] END AS types,
    CASE v WHEN 7 THEN ['en', 'src1'] ELSE []::VARCHAR[] END AS want_tags,
    CASE v WHEN 5 THEN 0.0 WHEN 6 THEN 1.0 ELSE 0.3 END AS alpha,
    CASE v WHEN 8 THEN 5 WHEN 11 THEN 20 ELSE 10 END AS lim,
    CASE v WHEN 8 THEN 1000 WHEN 11 THEN 5 ELSE 0 END AS off
  FROM bq, range(13) r(v)),
q AS (SELECT *, greatest((off + lim) * 3, 50) AS cand FROM rawq)"""

DEFAULT_QUERIES_CTE = """
bw AS (
  SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^\\p{L}\\p{N}\\s''-]', ' ', 'g'), '\\s+'),
                              lambda x: x <> '') AS w
  FROM benchmark),
q AS (
  SELECT item_id AS query_id, array_to_string(w, ' ') AS query, []::VARCHAR[] AS types,
         []::VARCHAR[] AS want_tags, 0.3 AS alpha, 10 AS lim, 0 AS off, 50 AS cand
  FROM bw)"""

FTS_CTES = f"""
fields AS (
  SELECT slug, 0 AS field, title AS text FROM concepts
  UNION ALL SELECT slug, 1, description FROM concepts
  UNION ALL SELECT slug, 2, CAST(to_json(tags) AS VARCHAR) FROM concepts
  UNION ALL SELECT slug, 3, body FROM concepts),
ftok AS (SELECT slug, field, {ftoks('text')} AS t FROM fields),
postings AS (SELECT slug, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM ftok),
doclen AS (SELECT slug, sum(len(t)) AS dl FROM ftok GROUP BY slug),
cstats AS (SELECT count(*) AS n_docs, avg(dl) AS avg_len FROM doclen),
qclean AS (SELECT query_id, replace(replace(query, '"', ''), '''', '') AS qc FROM q),
phr AS (
  SELECT query_id, unnest(string_split_regex(qc, '\\s+')) AS phrase,
         generate_subscripts(string_split_regex(qc, '\\s+'), 1) - 1 AS phrase_idx
  FROM qclean WHERE trim(regexp_replace(qc, '\\s+', ' ', 'g')) <> ''),
ptok0 AS (SELECT query_id, phrase_idx, {ftoks('phrase')} AS t FROM phr),
ptok AS (
  SELECT query_id, phrase_idx, len(t) AS n_tok, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS tok_idx
  FROM ptok0 WHERE len(t) > 0),
starts AS (
  SELECT query_id, phrase_idx, slug, field, pos - tok_idx AS st, count(DISTINCT tok_idx) AS k, any_value(n_tok) AS n_tok
  FROM postings JOIN ptok USING (term) GROUP BY ALL),
occ AS (SELECT query_id, phrase_idx, slug, field, count(*) AS occ FROM starts WHERE k = n_tok GROUP BY ALL),
per AS (
  SELECT query_id, phrase_idx, slug, sum(CASE WHEN field = 0 THEN 0.0 ELSE 1.0 END * occ) AS f
  FROM occ GROUP BY ALL),
dfp AS (SELECT query_id, phrase_idx, count(*) AS n_match FROM per GROUP BY ALL),
idf AS (
  SELECT query_id, phrase_idx,
    CASE WHEN ln((n_docs - n_match + 0.5) / (n_match + 0.5)) <= 0 THEN 1e-6
         ELSE ln((n_docs - n_match + 0.5) / (n_match + 0.5)) END AS idf
  FROM dfp, cstats),
ranked AS (
  SELECT per.query_id, per.slug,
    -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS rank
  FROM per JOIN idf USING (query_id, phrase_idx) JOIN doclen USING (slug), cstats GROUP BY ALL),
fts_top0 AS (
  SELECT r.query_id, r.slug, r.rank,
    row_number() OVER (PARTITION BY r.query_id ORDER BY round(r.rank, 9), r.slug) AS fts_pos, q.cand
  FROM ranked r JOIN q USING (query_id) JOIN concepts c ON c.slug = r.slug
  WHERE len(q.types) = 0 OR list_contains(q.types, c.type)),
fts_c AS (
  SELECT query_id, slug, rank, fts_pos,
    1 - abs(rank) / greatest(max(abs(rank)) OVER (PARTITION BY query_id), 1) AS fts_norm
  FROM fts_top0 WHERE fts_pos <= cand)"""

VEC_CTES = f"""
{embed_ctes('concepts', 'slug', 'body', 'd')},
{embed_ctes('q', 'query_id', 'query', 'q')},
dn AS (SELECT key, sqrt(sum(v * v)) AS n FROM dvec GROUP BY key),
qn AS (SELECT key, sqrt(sum(v * v)) AS n FROM qvec GROUP BY key),
dots AS (SELECT qv.key AS query_id, dv.key AS slug, sum(qv.v * dv.v) AS dot
         FROM qvec qv JOIN dvec dv USING (bin) GROUP BY ALL),
pairs AS (
  SELECT q.query_id, c.slug, 1 - coalesce(dots.dot, 0) / (dn.n * qn.n) AS distance, q.cand
  FROM q JOIN qn ON qn.key = q.query_id AND qn.n > 0
  JOIN concepts c ON len(q.types) = 0 OR list_contains(q.types, c.type)
  JOIN dn ON dn.key = c.slug AND dn.n > 0
  LEFT JOIN dots ON dots.query_id = q.query_id AND dots.slug = c.slug
  WHERE q.alpha > 0),
vec_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), slug) AS vec_pos FROM pairs),
vec_c AS (
  SELECT query_id, slug, distance, vec_pos,
    1 - distance / greatest(max(distance) OVER (PARTITION BY query_id), 1) AS vec_norm
  FROM vec_top WHERE vec_pos <= cand)"""

SEARCH_FEAT = feat_from(["dtok", "qtok"])

MERGE_CTES = """
merged AS (
  SELECT coalesce(f.query_id, v.query_id) AS query_id, coalesce(f.slug, v.slug) AS slug,
    f.fts_pos, v.vec_pos, f.fts_norm, v.vec_norm
  FROM fts_c f FULL OUTER JOIN vec_c v ON f.query_id = v.query_id AND f.slug = v.slug),
scored AS (
  SELECT m.*, q.alpha, q.want_tags, q.lim, q.off,
    CASE WHEN fts_norm IS NOT NULL AND vec_norm IS NOT NULL THEN (1 - q.alpha) * fts_norm + q.alpha * vec_norm
         WHEN fts_norm IS NOT NULL THEN fts_norm ELSE q.alpha * vec_norm END AS score
  FROM merged m JOIN q USING (query_id))"""


CONV_CONCEPTS_CTE = """
concepts AS (
  SELECT CAST(conv_id AS VARCHAR) || '/' || role || '-' || CAST(turn AS VARCHAR) AS slug, 'reference' AS type,
    '' AS title, '' AS description, []::VARCHAR[] AS tags, CAST(NULL AS VARCHAR) AS status, 'local' AS source,
    text AS body,
    CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INTEGER) AS body_length
  FROM conversations)"""


def _search_sql(queries_cte: str, select: str, concepts_cte: str = CONCEPTS_CTE) -> str:
    # The embedding CTEs reference ``hashed`` (built from ``feat``), which
    # needs the token tables first; DuckDB resolves CTEs in order.
    emb_d = embed_ctes('concepts', 'slug', 'body', 'd')
    emb_q = embed_ctes('q', 'query_id', 'query', 'q')
    d_tok, d_rest = emb_d.split("),\n", 1)
    q_tok, q_rest = emb_q.split("),\n", 1)
    vec_rest = VEC_CTES.replace(emb_d, "").replace(emb_q, "").lstrip(",\n")
    return (
        "WITH " + concepts_cte + ",\n" + queries_cte + ",\n" + FTS_CTES + ",\n"
        + d_tok + "),\n" + q_tok + "),\n" + SEARCH_FEAT + ",\n" + MURMUR_CTES + ",\n"
        + d_rest + ",\n" + q_rest + ",\n" + vec_rest + ",\n" + MERGE_CTES + "\n" + select
    )


PAGE_SELECT = """
, final AS (
  SELECT s.*, c.type, c.title, c.description, c.tags, c.status, c.source, c.body_length, c.body,
    count(*) OVER (PARTITION BY s.query_id) AS total,
    row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.fts_pos NULLS LAST,
                       s.vec_pos NULLS LAST, s.slug) AS position
  FROM scored s JOIN concepts c USING (slug)
  WHERE list_has_all(c.tags, s.want_tags))
SELECT query_id, CAST(position - off AS INTEGER) AS position, slug, type, title, description,
  CAST(to_json(tags) AS VARCHAR) AS tags, status, source, body_length,
  CAST(floor((body_length + 2) / 4) AS BIGINT) AS approx_tokens, round(score, 2) AS score,
  @SNIPPET@,
  total
FROM final WHERE position > off AND position <= off + lim""".replace("@SNIPPET@", SNIPPET)


def search_sql(default_queries: bool = False, concepts_cte: str = CONCEPTS_CTE) -> str:
    qcte = DEFAULT_QUERIES_CTE if default_queries else QUERIES_CTE
    body = _search_sql(qcte, "", concepts_cte)
    # PAGE_SELECT begins with an extra CTE.
    return body + PAGE_SELECT


def merge_sql() -> str:
    return _search_sql(QUERIES_CTE, "SELECT query_id, slug, round(score, 6) AS score, round(fts_norm, 6) AS fts_norm, "
                       "round(vec_norm, 6) AS vec_norm FROM scored")


def fts_sql(select: str) -> str:
    return "WITH " + CONCEPTS_CTE + ",\n" + QUERIES_CTE + ",\n" + FTS_CTES + "\n" + select


def embed_docs_sql() -> str:
    emb = embed_ctes('concepts', 'slug', 'body', 'd')
    tok, rest = emb.split("),\n", 1)
    return ("WITH " + CONCEPTS_CTE + ",\n" + tok + "),\n" + feat_from(["dtok"]) + ",\n" + MURMUR_CTES + ",\n"
            + rest + "\nSELECT key AS slug, bin, round(v, 6) AS value FROM dvec")


def murmur_tokens_sql() -> str:
    return ("WITH " + CONCEPTS_CTE + ",\n"
            f"dtok AS (SELECT {etoks('body')} AS t FROM concepts),\n"
            "featd AS (SELECT DISTINCT unnest(t) AS f FROM dtok),\n"
            f"feat AS (SELECT f, {_bytes('f')} AS b FROM featd),\n" + MURMUR_CTES + "\n"
            "SELECT f AS token, hash, CAST(hash % 256 AS INTEGER) AS bin, "
            "CAST(CASE WHEN hash % 2 = 1 THEN 1 ELSE -1 END AS INTEGER) AS sign FROM hashed")


KNN_SQL = """
WITH e AS (SELECT vec_id, embedding FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
      / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
         * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS distance
  FROM e a, e b),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS vec_pos FROM pairs)
SELECT query_id, vec_id, CAST(vec_pos AS INTEGER) AS vec_pos,
  CASE WHEN round(distance, 6) = 0 THEN 0.0 ELSE round(distance, 6) END AS distance,
  round(1 - distance / greatest(max(distance) OVER (PARTITION BY query_id), 1), 6) AS vec_norm
FROM top WHERE vec_pos <= 10"""
