"""Front-matter split (P1), YAML to JSON (P2) and tag normalisation.

The split is a JVM regular expression.  Only the YAML text of rows that have
a front-matter block crosses into Python, in Arrow batches, where a YAML
loader restricted to the JSON schema turns it into JSON plus the handful of
scalar attributes the corpus needs, already resolved with JavaScript
truthiness (empty string, 0, false and null fall through).
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Front matter starts the content: '---', newline, the YAML block (lazy), a
# newline and '---', then at most one newline.  LF only: CRLF never matches.
FRONT_MATTER_RE = r"^---\n[\s\S]*?\n---\n?"

PARSED_SCHEMA = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("fm", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("fm_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("tags_kind", T.StringType()),
        T.StructField("tags_items", T.ArrayType(T.StringType())),
        T.StructField("tags_text", T.StringType()),
        T.StructField("deps", T.ArrayType(T.StringType())),
    ]
)


def _json_schema_loader():
    import yaml

    # libyaml's parser when present (about 7x faster); resolution and
    # construction stay in Python either way, so the dialect is the same.
    base = getattr(yaml, "CSafeLoader", None) if getattr(yaml, "__with_libyaml__", False) else None

    class JsonSchemaLoader(base or yaml.SafeLoader):
        """SafeLoader with only the JSON-schema scalars: null, bool, int, float.

        Dates, yes/no/on/off and merge keys stay plain strings; duplicate keys
        raise, so the whole block is treated as invalid.
        """

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key_node, _ in node.value:
                key = self.construct_object(key_node, deep=True)
                try:
                    hashable = key in seen
                except TypeError:
                    hashable = False
                    key = repr(key)
                if hashable:
                    raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key!r}", key_node.start_mark)
                seen.add(key)
            return super().construct_mapping(node, deep=deep)

    JsonSchemaLoader.yaml_implicit_resolvers = {}
    resolvers = [
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", list("~nN") + [""]),
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        (
            "tag:yaml.org,2002:int",
            r"^(?:[-+]?0b[0-1_]+|[-+]?0o?[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+)$",
            list("-+0123456789"),
        ),
        (
            "tag:yaml.org,2002:float",
            r"^(?:[-+]?(?:\.[0-9]+|[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?"
            r"|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$",
            list("-+0123456789."),
        ),
    ]
    for tag, pattern, first in resolvers:
        JsonSchemaLoader.add_implicit_resolver(tag, re.compile(pattern), first)

    def construct_int(loader, node):
        text = loader.construct_scalar(node).replace("_", "")
        sign = -1 if text.startswith("-") else 1
        text = text.lstrip("+-")
        if text.startswith("0b"):
            return sign * int(text[2:], 2)
        if text.startswith("0x"):
            return sign * int(text[2:], 16)
        if text.startswith("0o"):
            return sign * int(text[2:], 8)
        return sign * int(text, 10)

    JsonSchemaLoader.add_constructor("tag:yaml.org,2002:int", construct_int)
    return yaml, JsonSchemaLoader


_LOADER = None


def _loader():
    global _LOADER
    if _LOADER is None:
        _LOADER = _json_schema_loader()
    return _LOADER


def _js_value(v):
    """Make a loaded value JSON-compatible the way JSON.stringify would."""
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return None
        if v.is_integer() and abs(v) < 1e21:
            return int(v)
        return v
    if isinstance(v, dict):
        return {str(k): _js_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_js_value(x) for x in v]
    if isinstance(v, (str, int, bool)) or v is None:
        return v
    return str(v)


def _js_truthy(v) -> bool:
    if v is None or v is False:
        return False
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return v != 0 and not (isinstance(v, float) and math.isnan(v))
    if isinstance(v, str):
        return v != ""
    return True


def _js_string(v) -> str:
    if isinstance(v, str):
        return v
    if v is True:
        return "true"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, (dict, list)):
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return str(v)


def parse_yaml_block(text):
    """One YAML block -> tuple in PARSED_SCHEMA order (None input -> not ok)."""
    if text is None:
        return (False, "{}", None, None, None, None, None, None, None, None, None, None)
    yaml, loader = _loader()
    try:
        fm = yaml.load(text, Loader=loader)  # noqa: S506 - restricted SafeLoader subclass
        fm = _js_value(fm)
        fm_json = json.dumps(fm if _js_truthy(fm) else {}, separators=(",", ":"), ensure_ascii=False)
    except Exception:
        return (False, "{}", None, None, None, None, None, None, None, None, None, None)
    if not _js_truthy(fm):
        fm = {}
    get = fm.get if isinstance(fm, dict) else (lambda _k: None)

    def scalar(key):
        v = get(key)
        return _js_string(v) if _js_truthy(v) else None

    title = scalar("title") or scalar("name")
    tags = get("tags")
    if tags is None:
        kind, items, tag_text = None, None, None
    elif isinstance(tags, list):
        kind, items, tag_text = "array", [_js_string(t) if t is not None else None for t in tags], None
    elif isinstance(tags, str):
        kind, items, tag_text = "string", None, tags
    else:
        kind, items, tag_text = "other", None, None
    deps = get("dependencies")
    deps = [_js_string(d) if d is not None else None for d in deps] if isinstance(deps, list) else None
    return (
        True,
        fm_json,
        title,
        scalar("description"),
        scalar("type"),
        scalar("status"),
        scalar("timestamp"),
        scalar("resource"),
        kind,
        items,
        tag_text,
        deps,
    )


_ARROW_TYPES = {T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.ArrayType(T.StringType()): pa.list_(pa.string())}
_PARSED_ARROW = pa.struct([(f.name, _ARROW_TYPES[f.dataType]) for f in PARSED_SCHEMA])


def _parse_yaml_batch(blocks: pa.Array) -> pa.Array:
    names = PARSED_SCHEMA.fieldNames()
    return pa.array([dict(zip(names, parse_yaml_block(b.as_py()))) for b in blocks], _PARSED_ARROW)


# Marked non-deterministic only to make it an optimisation barrier: Catalyst
# then never duplicates it into pushed-down filters or collapsed projections,
# so each YAML block is parsed exactly once.
parse_yaml_udf = F.arrow_udf(_parse_yaml_batch, PARSED_SCHEMA).asNondeterministic()


def front_matter_block(content: Column) -> Column:
    """The whole matched front-matter block, or '' when there is none."""
    return F.regexp_extract(content, FRONT_MATTER_RE, 0)


def yaml_between(block_col: str) -> Column:
    b = F.col(block_col)
    return F.when(
        F.length(b) > 0,
        F.expr(
            f"substring({block_col}, 5, length({block_col}) - 8 - "
            f"CASE WHEN endswith({block_col}, '\\n---\\n') THEN 1 ELSE 0 END)"
        ),
    )


def normalize_tags(kind: Column, items: Column, text: Column) -> Column:
    """Null -> [], array as is, string -> trim/split on ','/trim/drop empty."""
    split = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), ",")
    trimmed = F.transform(split, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return (
        F.when(kind == "array", items)
        .when(kind == "string", F.filter(trimmed, lambda x: x != ""))
        .otherwise(F.array().cast("array<string>"))
    )
