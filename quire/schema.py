"""Fixed schemas and configuration values of the concept corpus."""

from __future__ import annotations

from pyspark.sql import types as T

EMBEDDING_DIM = 256

CONCEPT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("slug", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("tags", T.ArrayType(T.StringType()), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("frontmatter", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("body_length", T.IntegerType(), True),
        T.StructField("file_path", T.StringType(), True),
        T.StructField("file_hash", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("resource", T.StringType(), True),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("updated_at", T.LongType(), False),
        T.StructField("last_synced_at", T.LongType(), True),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    ]
)

CONCEPT_COLUMNS = [f.name for f in CONCEPT_SCHEMA.fields]

# Fixed values that must equal the reference's defaults.
# Type schema: allowed statuses and the default status per concept type.
# An empty status list means "not validated"; a missing default means null.
TYPE_SCHEMAS = {
    "skill": (["stable", "draft", "deprecated"], "stable"),
    "agent": (["stable", "draft", "deprecated"], "stable"),
    "instruction": (["stable", "draft", "deprecated"], "stable"),
    "prompt": (["stable", "draft", "deprecated"], "stable"),
    "workflow": (["stable", "draft", "deprecated"], "stable"),
    "reference": ([], None),
    "knowledge": ([], None),
}
# Status used for types that have no schema at all.
UNKNOWN_TYPE_STATUS = "stable"

# Search page 10 and alpha 0.3; list page 50; HTTP page cap 200;
# at least 50 candidates per search side, three times the page end otherwise.
SEARCH_DEFAULTS = {"limit": 10, "alpha": 0.3}
LIST_DEFAULTS = {"limit": 50, "max_limit": 200}
MIN_CANDIDATES = 50
CANDIDATE_FACTOR = 3

# File names the directory walk never indexes (compared lowercased),
# and directory names it never descends into (besides names starting with ".").
SKIP_FILE_NAMES = ["readme.md", "changelog.md", "contributing.md", "license.md"]
SKIP_DIR_NAMES = ["node_modules"]

# BM25 constants of the full-text ranking (k1, b) and per-field weights in the
# order title, description, tags, body: the title is indexed but weighs 0.
BM25_K1 = 1.2
BM25_B = 0.75
FTS_FIELDS = ["title", "description", "tags", "body"]
FTS_WEIGHTS = {"title": 0.0, "description": 1.0, "tags": 1.0, "body": 1.0}
# idf of a phrase that occurs in at least half the rows is replaced by this.
BM25_MIN_IDF = 1e-6


def type_schema_rows():
    """Rows ``(type, statuses, default_status)`` for a small lookup DataFrame."""
    return [(t, s, d) for t, (s, d) in TYPE_SCHEMAS.items()]


TYPE_SCHEMA_DDL = "type string, statuses array<string>, default_status string"
