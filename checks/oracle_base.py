"""DuckDB CTEs shared by the oracle SQL: the fixture files and the concept
attributes they were rendered from (known without parsing any front matter)."""

NL = "chr(10)"

# The longest prefix of at most 200 UTF-16 units: a character beyond U+FFFF counts twice.
SNIPPET = r"""CASE WHEN description <> '' THEN description ELSE replace(substr(body, 1, list_max(list_filter(range(100, 201),
  lambda n: n + length(regexp_replace(substr(body, 1, n), '[^\x{10000}-\x{10FFFF}]', '', 'g')) <= 200))), chr(10), ' ') END AS snippet"""

def files_cte(src: str = "documents", name: str = "files", tag: str = "") -> str:
    return f"""
fx{tag} AS (
  SELECT doc_id, text, lang, source, doc_id % 10 AS m, doc_id // 10 AS k,
         CAST(doc_id AS VARCHAR) AS ds, CAST(doc_id // 10 AS VARCHAR) AS ks
  FROM {src}
),
fy{tag} AS (
  SELECT *, concat_ws({NL},
      CASE doc_id % 3 WHEN 0 THEN 'title: Doc ' || ds WHEN 1 THEN 'name: Doc ' || ds END,
      CASE WHEN doc_id % 4 = 0 THEN 'description: About doc ' || ds END,
      CASE m WHEN 6 THEN 'type: Knowledge' WHEN 8 THEN 'type: Template' END,
      CASE doc_id % 4 WHEN 0 THEN 'tags: [' || lang || ', ' || source || ']'
                      WHEN 1 THEN 'tags:' || {NL} || '  - ' || lang || {NL} || '  - ' || source
                      WHEN 2 THEN 'tags: ' || lang || ', ' || source END,
      CASE doc_id % 5 WHEN 0 THEN 'status: draft' WHEN 1 THEN 'status: deprecated'
                      WHEN 2 THEN 'status: bogus' WHEN 3 THEN 'status: stable' END,
      CASE WHEN m = 0 THEN 'dependencies: [' || concat_ws(', ',
          's' || CAST(2 * k + 1 AS VARCHAR), 's' || CAST(2 * k + 2 AS VARCHAR),
          CASE WHEN k % 5 = 0 THEN 'ghost-' || ks END,
          CASE WHEN k > 0 AND k % 7 = 0 THEN 's' || CAST(k // 2 AS VARCHAR) END) || ']' END,
      CASE WHEN doc_id % 6 = 0 THEN 'timestamp: 2024-01-01' END) AS yaml
  FROM fx{tag}
),
{name} AS (
  SELECT doc_id, m, k, ds, ks, lang, source, text,
    CASE m WHEN 0 THEN '/kb/skills/s' || ks || '/SKILL.md'
           WHEN 1 THEN '/kb/skills/s' || ks || '/references/r' || ds || '.md'
           WHEN 2 THEN '/kb/agents/a' || ds || '.md'
           WHEN 3 THEN '/kb/prompts/p' || ds || '.md'
           WHEN 4 THEN '/kb/workflows/w' || ds || '.md'
           WHEN 5 THEN '/kb/instructions/i' || ds || '.md'
           WHEN 6 THEN '/kb/knowledge/' || source || '/k' || ds || '.md'
           WHEN 7 THEN '/kb/notes/n' || ds || '.md'
           WHEN 8 THEN '/kb/notes/' || lang || '/n' || ds || '.md'
           ELSE CASE WHEN doc_id % 20 = 9 THEN '/kb/notes/d' || ds || '/README.md'
                     ELSE '/kb/notes/node_modules/x' || ds || '.md' END END AS file_path,
    CASE WHEN m = 7 THEN text ELSE '---' || {NL} || yaml || {NL} || '---' || {NL} || text END AS content,
    1704067200 + 60 * doc_id AS indexed_at
  FROM fy{tag}
)"""



FILES_CTE = files_cte()

HOUSE_RULES_CONTENT_SQL = (
    "'---' || chr(10) || 'title: House rules' || chr(10) || "
    "'description: Conventions for every concept' || chr(10) || '---' || chr(10) || "
    "'Keep each concept small.' || chr(10)"
)

# Expected concept rows: every kept fixture file plus the explicit file root.
CONCEPTS_CTE = FILES_CTE + f""",
kept AS (SELECT * FROM files WHERE m <> 9),
cx AS (
  SELECT doc_id, file_path, content, text AS body,
    CASE m WHEN 0 THEN 's' || ks WHEN 1 THEN 's' || ks || '/references/r' || ds
           WHEN 2 THEN 'agents/a' || ds WHEN 3 THEN 'prompts/p' || ds
           WHEN 4 THEN 'workflows/w' || ds WHEN 5 THEN 'instructions/i' || ds
           WHEN 6 THEN source || '/k' || ds WHEN 7 THEN 'notes/n' || ds
           ELSE lang || '/n' || ds END AS slug,
    CASE m WHEN 0 THEN 'skill' WHEN 1 THEN 'reference' WHEN 2 THEN 'agent' WHEN 3 THEN 'prompt'
           WHEN 4 THEN 'workflow' WHEN 5 THEN 'instruction' WHEN 6 THEN 'knowledge'
           WHEN 7 THEN 'reference' ELSE 'template' END AS type,
    CASE WHEN m <> 7 AND doc_id % 3 IN (0, 1) THEN 'Doc ' || ds ELSE '' END AS title,
    CASE WHEN m <> 7 AND doc_id % 4 = 0 THEN 'About doc ' || ds ELSE '' END AS description,
    CASE WHEN m <> 7 AND doc_id % 4 IN (0, 1, 2) THEN [lang, source] ELSE []::VARCHAR[] END AS tags,
    CASE WHEN m <> 7 THEN CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'deprecated'
                                          WHEN 2 THEN 'bogus' WHEN 3 THEN 'stable' END END AS raw_status,
    CASE WHEN m <> 7 AND doc_id % 6 = 0 THEN '2024-01-01' END AS timestamp,
    CASE WHEN m = 0 THEN list_filter(['s' || CAST(2 * k + 1 AS VARCHAR), 's' || CAST(2 * k + 2 AS VARCHAR),
          CASE WHEN k % 5 = 0 THEN 'ghost-' || ks END,
          CASE WHEN k > 0 AND k % 7 = 0 THEN 's' || CAST(k // 2 AS VARCHAR) END], lambda x: x IS NOT NULL)
    END AS deps,
    indexed_at
  FROM kept
  UNION ALL
  SELECT -1, '/kb/house-rules.md', {HOUSE_RULES_CONTENT_SQL}, 'Keep each concept small.' || chr(10),
    'house-rules', 'instruction', 'House rules', 'Conventions for every concept', []::VARCHAR[],
    NULL, NULL, NULL, 1704067200 - 60
),
concepts AS (
  SELECT doc_id, slug, type, title, description, tags,
    CASE WHEN type IN ('skill', 'agent', 'instruction', 'prompt', 'workflow')
           THEN CASE WHEN raw_status IN ('stable', 'draft', 'deprecated') THEN raw_status ELSE 'stable' END
         WHEN type IN ('reference', 'knowledge') THEN raw_status
         ELSE coalesce(raw_status, 'stable') END AS status,
    body,
    CAST(length(body) + length(regexp_replace(body, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER) AS body_length,
    file_path, sha256(content) AS file_hash, 'local' AS source, timestamp, CAST(NULL AS VARCHAR) AS resource,
    indexed_at AS created_at, indexed_at AS updated_at, deps
  FROM cx
)"""


def with_concepts(body: str) -> str:
    return "WITH " + CONCEPTS_CTE + "\n" + body


def with_files(body: str) -> str:
    return "WITH " + FILES_CTE + "\n" + body
