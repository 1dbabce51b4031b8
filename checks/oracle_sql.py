"""DuckDB oracle SQL, one statement per registered plan."""

from checks.oracle_base import SNIPPET, with_concepts, with_files

TAGS = "CAST(to_json(tags) AS VARCHAR) AS tags"
APPROX = "CAST(floor((body_length + 2) / 4) AS BIGINT)"

LIST_COLS = (
    f"slug, type, title, description, {TAGS}, status, source, timestamp, body_length, "
    f"created_at, updated_at, {APPROX} AS approx_tokens"
)


def _list(where: str, limit: int, offset: int) -> str:
    return with_concepts(
        f"SELECT {LIST_COLS}, (SELECT count(*) FROM concepts WHERE {where}) AS total "
        f"FROM concepts WHERE {where} ORDER BY updated_at DESC, slug LIMIT {limit} OFFSET {offset}"
    )


ORACLE = {
    "parse_frontmatter": with_concepts(
        f"SELECT slug, title, description, {TAGS}, timestamp, "
        "CAST(to_json(deps) AS VARCHAR) AS deps, sha256(body) AS body_sha256 FROM concepts"
    ),
    "normalize_tags": with_concepts(f"SELECT slug, {TAGS}, CAST(len(tags) AS INTEGER) AS n_tags FROM concepts"),
    "infer_type": with_concepts("SELECT file_path, type FROM concepts"),
    "derive_slug": with_concepts("SELECT file_path, slug FROM concepts"),
    "resolve_status": with_concepts("SELECT slug, type, status FROM concepts"),
    "project_metadata": with_concepts("SELECT slug, title, description, timestamp, resource FROM concepts"),
    "content_hash": with_concepts("SELECT file_path, file_hash FROM concepts"),
    "token_estimate": with_concepts(f"SELECT slug, body_length, {APPROX} AS approx_tokens FROM concepts"),
    "snippet": with_concepts(
        f"SELECT slug, {SNIPPET} FROM concepts"
    ),
    "render_context": with_concepts(
        "SELECT slug, '(' || type || ') ' || slug || ': ' || title || chr(10) || chr(10) || body AS context "
        "FROM concepts"
    ),
    "normalize_types": with_concepts(
        "SELECT slug, type, CAST(CASE WHEN body <> '' THEN length(body) ELSE 0 END AS INTEGER) AS body_length "
        "FROM concepts"
    ),
    "scan_filter": with_files(
        "SELECT file_path FROM files WHERE m <> 9 UNION ALL SELECT '/kb/house-rules.md'"
    ),
    "scan_roots": with_files(
        "SELECT CASE WHEN m IN (0, 1) THEN '/kb/skills' WHEN m = 2 THEN '/kb/agents' "
        "WHEN m = 3 THEN '/kb/prompts' WHEN m = 4 THEN '/kb/workflows' WHEN m = 5 THEN '/kb/instructions' "
        "WHEN m = 6 THEN '/kb/knowledge' ELSE '/kb/notes' END AS root, count(*) AS n_files "
        "FROM files WHERE m <> 9 GROUP BY 1 UNION ALL SELECT '/kb/house-rules.md', 1"
    ),
    "list_concepts": _list("status = 'draft'", 50, 20),
    "list_concepts_deep": _list("true", 130, 437),
    "list_tags_like": _list(
        "CAST(to_json(tags) AS VARCHAR) ILIKE '%\"EN\"%' AND CAST(to_json(tags) AS VARCHAR) ILIKE '%\"src1_\"%'",
        50, 0,
    ),
    "filter_tags_all": with_concepts(f"SELECT slug, {TAGS} FROM concepts WHERE list_has_all(tags, ['en', 'src1'])"),
    "filter_type_in": with_concepts("SELECT slug, type FROM concepts WHERE type IN ('skill', 'agent', 'Workflow')"),
    "changes_since": with_concepts(
        "SELECT slug, type, title, status, updated_at FROM concepts WHERE updated_at > 1704067200 + 60 * 500"
    ),
    "stats_by_type": with_concepts(
        "SELECT type, count(*) AS count, (SELECT count(*) FROM concepts) AS total FROM concepts GROUP BY type"
    ),
    "tag_counts": with_concepts(
        "SELECT name, count(*) AS count FROM (SELECT unnest(tags) AS name FROM (SELECT DISTINCT tags FROM concepts)) "
        "GROUP BY name"
    ),
    "tag_counts_concepts": with_concepts(
        "SELECT name, count(*) AS count FROM (SELECT unnest(tags) AS name FROM concepts) GROUP BY name"
    ),
    "tag_counts_typed": with_concepts(
        "SELECT name, count(*) AS count FROM (SELECT unnest(tags) AS name FROM "
        "(SELECT DISTINCT tags FROM concepts WHERE type = 'knowledge')) GROUP BY name"
    ),
    "get_by_slug": with_concepts(
        "SELECT c.slug, c.title, c.type FROM concepts c "
        "JOIN (SELECT DISTINCT unnest(deps) AS slug FROM concepts) k ON c.slug = k.slug"
    ),
}

from checks import oracle_search as _s  # noqa: E402

ORACLE.update(
    {
        "tokenize_fts": with_concepts(
            f"SELECT slug, CAST(len({_s.ftoks('body')}) AS INTEGER) AS n_tokens, "
            f"sha256(array_to_string({_s.ftoks('body')}, ' ')) AS tokens_sha256 FROM concepts"
        ),
        "postings_df": _s.fts_sql("SELECT slug, field, CAST(pos AS INTEGER) AS pos, term FROM postings"),
        "corpus_stats": _s.fts_sql(
            "SELECT n_docs, round(avg_len, 6) AS avg_len, (SELECT count(DISTINCT term) FROM postings) AS n_terms FROM cstats"
        ),
        "parse_match_query": _s.fts_sql(
            f"SELECT query_id, CAST(phrase_idx AS INTEGER) AS phrase_idx, phrase, CAST(len({_s.ftoks('phrase')}) AS INTEGER) AS n_tok FROM phr"
        ),
        "fts_match": _s.fts_sql("SELECT DISTINCT query_id, slug FROM occ"),
        "bm25_topk": _s.fts_sql("SELECT query_id, slug, CAST(fts_pos AS INTEGER) AS fts_pos, round(rank, 6) AS rank FROM fts_c"),
        "embed_documents": _s.embed_docs_sql(),
        "murmur3_tokens": _s.murmur_tokens_sql(),
        "knn_cosine": _s.KNN_SQL,
        "hybrid_merge": _s.merge_sql(),
        "hybrid_search": _s.search_sql(default_queries=True),
        "hybrid_search_batch": _s.search_sql(),
    }
)

_PREFIXES = """
pre AS (
  SELECT slug AS child_slug, title AS child_title, type AS child_type, source AS child_source,
    array_to_string(string_split(slug, '/')[1:i], '/') AS prefix, i AS level
  FROM concepts, range(1, len(string_split(slug, '/'))) r(i))"""
_EDGES = """
edges AS (
  SELECT slug AS src, unnest(deps) AS dst, generate_subscripts(deps, 1) - 1 AS ord FROM concepts WHERE deps IS NOT NULL)"""
# Concepts reachable through dependencies, by shortest depth.
_REACH = """
live AS (SELECT DISTINCT e.src, e.dst FROM edges e JOIN concepts c ON c.slug = e.dst),
reach AS (
  WITH RECURSIVE r(root, slug, depth) USING KEY (root, slug) AS (
    SELECT src, dst, 1 FROM live WHERE dst <> src
    UNION
    SELECT r.root, e.dst, r.depth + 1 FROM r JOIN live e ON e.src = r.slug
    LEFT JOIN recurring.r AS prev ON prev.root = r.root AND prev.slug = e.dst
    WHERE prev.slug IS NULL AND e.dst <> r.root)
  SELECT * FROM r)"""

ORACLE.update(
    {
        "references": with_concepts(
            "," + _PREFIXES + "\nSELECT p.slug, c.child_slug AS ref_slug, c.child_title AS ref_title, "
            "c.child_type AS ref_type FROM concepts p JOIN pre c ON lower(p.slug) = lower(c.prefix) "
            "AND p.source = c.child_source"
        ).replace("WITH ", "WITH ", 1).replace(")\n,\npre AS", "),\npre AS"),
        "referenced_by": with_concepts(
            "," + _PREFIXES + "\nSELECT c.child_slug AS slug, c.prefix AS ancestor_slug, a.title AS anc_title, "
            "a.type AS anc_type, CAST(c.level AS INTEGER) AS level FROM pre c JOIN concepts a ON a.slug = c.prefix"
        ).replace(")\n,\npre AS", "),\npre AS"),
        "dependencies": with_concepts(
            "," + _EDGES + "\nSELECT e.src AS slug, e.dst AS dep_slug, CAST(e.ord AS INTEGER) AS ord, c.title AS dep_title "
            "FROM edges e LEFT JOIN concepts c ON c.slug = e.dst"
        ).replace(")\n,\nedges AS", "),\nedges AS"),
        "dependents": with_concepts(
            "," + _EDGES + "\nSELECT DISTINCT e.dst AS slug, e.src AS dependent_slug, s.title AS dependent_title "
            "FROM edges e JOIN concepts t ON t.slug = e.dst JOIN concepts s ON s.slug = e.src"
        ).replace(")\n,\nedges AS", "),\nedges AS"),
        "get_concept_tree": with_concepts(
            "," + _EDGES + """,
live AS (SELECT e.src, e.dst, lpad(CAST(min(e.ord) AS VARCHAR), 6, '0') AS place FROM edges e JOIN concepts c ON c.slug = e.dst
         WHERE e.src <> e.dst GROUP BY 1, 2),
r AS (
  WITH RECURSIVE r(root, slug, parent, key) USING KEY (root, slug) AS (
    SELECT DISTINCT src, src, NULL::VARCHAR, '' FROM live
    UNION
    SELECT r.root, e.dst, arg_min(r.slug, r.key || e.place), min(r.key || e.place)
    FROM r JOIN live e ON e.src = r.slug LEFT JOIN recurring.r AS had ON had.root = r.root AND had.slug = e.dst
    WHERE e.dst <> r.root AND (had.slug IS NULL OR r.key || e.place < had.key)
    GROUP BY r.root, e.dst)
  SELECT * FROM r)
SELECT r.root, row_number() OVER (PARTITION BY r.root ORDER BY r.key) - 1 AS position, r.slug, r.parent,
  CAST(length(r.key) / 6 AS INTEGER) AS depth, c.title, c.type FROM r JOIN concepts c ON c.slug = r.slug"""
        ).replace(")\n,\nedges AS", "),\nedges AS"),
        "resolve_dependencies": with_concepts(
            "," + _EDGES + """,
live AS (SELECT DISTINCT e.src, e.dst FROM edges e JOIN concepts c ON c.slug = e.dst),
r AS (
  WITH RECURSIVE r(root, slug, depth) USING KEY (root, slug) AS (
    SELECT src, dst, 1 FROM live WHERE dst <> src
    UNION
    SELECT r.root, e.dst, r.depth + 1 FROM r JOIN live e ON e.src = r.slug
    LEFT JOIN recurring.r AS prev ON prev.root = r.root AND prev.slug = e.dst
    WHERE prev.slug IS NULL AND e.dst <> r.root)
  SELECT * FROM r)
SELECT root, slug, CAST(depth AS INTEGER) AS depth FROM r"""
        ).replace(")\n,\nedges AS", "),\nedges AS"),
        "get_concept": with_concepts(
            "," + _PREFIXES + "," + _EDGES + "," + _REACH + """
SELECT slug, 'self' AS relation, slug AS other_slug, 0 AS ord, title, type, description,
  CAST(to_json(tags) AS VARCHAR) AS tags, status, source, timestamp, resource, body_length,
  CAST(floor((body_length + 2) / 4) AS BIGINT) AS approx_tokens, body FROM concepts
UNION ALL BY NAME
SELECT p.slug, 'reference' AS relation, c.child_slug AS other_slug, 0 AS ord, c.child_title AS title, c.child_type AS type
FROM concepts p JOIN pre c ON lower(p.slug) = lower(c.prefix) AND p.source = c.child_source
UNION ALL BY NAME
SELECT c.child_slug AS slug, 'referenced_by' AS relation, c.prefix AS other_slug, CAST(c.level AS INTEGER) AS ord, a.title, a.type
FROM pre c JOIN concepts a ON a.slug = c.prefix
UNION ALL BY NAME
SELECT e.src AS slug, 'dependency' AS relation, e.dst AS other_slug, CAST(e.ord AS INTEGER) AS ord, c.title
FROM edges e LEFT JOIN concepts c ON c.slug = e.dst
UNION ALL BY NAME
SELECT r.root AS slug, 'resolved' AS relation, r.slug AS other_slug, CAST(r.depth AS INTEGER) AS ord, c.title, c.type
FROM reach r JOIN concepts c ON c.slug = r.slug"""
        ).replace(")\n,\npre AS", "),\npre AS"),
    }
)

from checks.oracle_base import files_cte  # noqa: E402

_SLUG = """CASE m WHEN 0 THEN 's' || ks WHEN 1 THEN 's' || ks || '/references/r' || ds
           WHEN 2 THEN 'agents/a' || ds WHEN 3 THEN 'prompts/p' || ds
           WHEN 4 THEN 'workflows/w' || ds WHEN 5 THEN 'instructions/i' || ds
           WHEN 6 THEN source || '/k' || ds WHEN 7 THEN 'notes/n' || ds
           ELSE lang || '/n' || ds END"""

_PAIR = (
    "WITH prevdocs AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || ' v1' ELSE text END AS text, lang, source "
    "FROM documents WHERE doc_id % 11 <> 0),\n"
    "curdocs AS (SELECT * FROM documents WHERE doc_id % 17 <> 0),\n"
    + files_cte("prevdocs", "pf", "_p") + ",\n" + files_cte("curdocs", "cf", "_c") + f""",
prev AS (
  SELECT file_path, {_SLUG} AS slug, sha256(content) AS file_hash,
    CASE WHEN doc_id % 19 = 0 THEN 'remote' ELSE 'local' END AS source, indexed_at AS created_at,
    indexed_at AS updated_at, doc_id, m
  FROM pf WHERE m <> 9),
cur AS (SELECT file_path, {_SLUG} AS slug, sha256(content) AS file_hash, indexed_at + 86400 AS t, doc_id, m
        FROM cf WHERE m <> 9),
diff AS (
  SELECT coalesce(c.file_path, p.file_path) AS file_path,
    CASE WHEN c.file_path IS NOT NULL AND p.file_path IS NOT NULL AND c.file_hash = p.file_hash THEN 'skipped'
         WHEN c.file_path IS NOT NULL AND p.file_path IS NOT NULL THEN 'updated'
         WHEN c.file_path IS NOT NULL THEN 'added'
         WHEN p.source = 'local' THEN 'removed' ELSE 'kept' END AS action,
    coalesce(p.slug, c.slug) AS slug
  FROM cur c FULL OUTER JOIN prev p ON c.file_path = p.file_path)
"""
)

_NEXT = """,
nxt AS (
  SELECT p.slug, p.file_path, p.source, coalesce(c.file_hash, p.file_hash) AS file_hash, p.created_at,
    CASE WHEN c.file_hash IS NOT NULL AND c.file_hash <> p.file_hash THEN c.t ELSE p.updated_at END AS updated_at
  FROM prev p LEFT JOIN cur c ON c.file_path = p.file_path
  WHERE c.file_path IS NOT NULL OR p.source <> 'local'
  UNION ALL
  SELECT c.slug, c.file_path, 'local', c.file_hash, c.t, c.t
  FROM cur c LEFT JOIN prev p ON c.file_path = p.file_path WHERE p.file_path IS NULL)
"""

ORACLE.update(
    {
        "diff_snapshot": _PAIR + "SELECT file_path, action, slug FROM diff",
        "removed_concepts": _PAIR + "SELECT file_path, slug FROM diff WHERE action = 'removed'",
        "upsert_snapshot": _PAIR + _NEXT.replace(
            "SELECT p.slug, p.file_path, p.source,", "SELECT p.slug, p.file_path, p.source, p.doc_id,"
        ).replace("SELECT c.slug, c.file_path, 'local',", "SELECT c.slug, c.file_path, 'local', c.doc_id,")
        + """SELECT n.slug, n.file_path, n.source, n.file_hash, n.created_at, n.updated_at,
  CASE WHEN n.doc_id % 3 IN (0, 1) AND n.doc_id % 10 <> 7 THEN 'Doc ' || CAST(n.doc_id AS VARCHAR) ELSE '' END AS title,
  CASE WHEN n.doc_id % 10 IN (0, 2, 3, 4, 5) THEN
         CASE n.doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'deprecated' ELSE 'stable' END
       WHEN n.doc_id % 10 IN (1, 6) THEN
         CASE n.doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'bogus' WHEN 3 THEN 'stable' END
       WHEN n.doc_id % 10 = 8 THEN
         CASE n.doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'bogus' ELSE 'stable' END
  END AS status
FROM nxt n""",
        "index_summary": _PAIR + _NEXT + """SELECT
  CAST(count(*) FILTER (WHERE action = 'added') AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE action = 'updated') AS BIGINT) AS updated,
  CAST(count(*) FILTER (WHERE action = 'removed') AS BIGINT) AS removed,
  CAST(count(*) FILTER (WHERE action = 'skipped') AS BIGINT) AS skipped,
  (SELECT count(*) FROM nxt) AS total
FROM diff""",
        "index_partial": _PAIR + """SELECT c.file_path,
  CASE WHEN p.file_path IS NULL THEN 'added' WHEN p.file_hash = c.file_hash THEN 'skipped' ELSE 'updated' END AS action,
  coalesce(p.slug, c.slug) AS slug
FROM cur c LEFT JOIN prev p ON c.file_path = p.file_path WHERE c.m IN (7, 8)""",
        "deindex_slug": _PAIR + """, targets AS (
  SELECT DISTINCT 's' || CAST(x AS VARCHAR) AS slug FROM prev, unnest([2 * (doc_id // 10) + 1, 2 * (doc_id // 10) + 2,
    CASE WHEN (doc_id // 10) > 0 AND (doc_id // 10) % 7 = 0 THEN (doc_id // 10) // 2 END]) t(x)
  WHERE m = 0 AND x IS NOT NULL)
SELECT slug, source FROM prev WHERE NOT (slug IN (SELECT slug FROM targets) AND source = 'local')""",
        "deindex_prefix": _PAIR + """SELECT slug, source FROM prev
WHERE NOT ((file_path ILIKE '/KB/NOTES/%' OR file_path ILIKE '/kb/_gents/%') AND source = 'local')""",
        "slug_conflicts": with_concepts(
            "SELECT slug, CAST(2 AS BIGINT) AS n_paths, file_path AS first_path FROM concepts"
        ),
    }
)

ORACLE.update(
    {
        "index_run": with_concepts(
            "SELECT CAST(1 AS BIGINT) AS run, count(*) AS added, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS removed, "
            "CAST(0 AS BIGINT) AS skipped, count(*) AS total FROM concepts UNION ALL "
            "SELECT 2, 0, 0, 0, count(*), count(*) FROM concepts"
        ),
        "stream_ingest": with_concepts("SELECT slug, file_hash, source FROM concepts"),
        "stream_run_summary": with_concepts(
            ", g AS (SELECT ((doc_id % 4) + 4) % 4 AS batch_id, count(*) AS added FROM concepts GROUP BY 1)\n"
            "SELECT CAST(batch_id AS BIGINT) AS batch_id, added, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS removed, "
            "CAST(sum(added) OVER (ORDER BY batch_id) AS BIGINT) AS total FROM g"
        ),
    }
)

_LAST_RECORDS = with_concepts("SELECT slug, file_hash, source FROM concepts WHERE ((doc_id % 5) + 5) % 5 <> 4")
ORACLE["stream_out_of_order"] = ORACLE["stream_after_batch"] = _LAST_RECORDS

# Terms of the snapshot after the run, counted from its texts.
ORACLE["index_refresh"] = _PAIR + f""", live AS (
  SELECT doc_id, m, ds, lang, source, text FROM cf WHERE m <> 9
  UNION ALL
  SELECT p.doc_id, p.m, p.ds, p.lang, p.source, p.text FROM pf p
  WHERE p.m <> 9 AND p.doc_id % 19 = 0 AND p.file_path NOT IN (SELECT file_path FROM cf WHERE m <> 9)),
fields AS (
  SELECT doc_id, CASE WHEN m <> 7 AND doc_id % 3 IN (0, 1) THEN 'Doc ' || ds ELSE '' END AS text FROM live
  UNION ALL SELECT doc_id, CASE WHEN m <> 7 AND doc_id % 4 = 0 THEN 'About doc ' || ds ELSE '' END FROM live
  UNION ALL SELECT doc_id, CASE WHEN m <> 7 AND doc_id % 4 IN (0, 1, 2) THEN CAST(to_json([lang, source]) AS VARCHAR) ELSE '' END FROM live
  UNION ALL SELECT doc_id, text FROM live),
tok AS (SELECT doc_id, unnest({_s.ftoks('text')}) AS term FROM fields)
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occ FROM tok GROUP BY term"""

ORACLE["conversation_search"] = _s.search_sql(default_queries=True, concepts_cte=_s.CONV_CONCEPTS_CTE)
